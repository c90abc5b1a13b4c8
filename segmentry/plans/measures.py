"""Queries of the metric, particle and session operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from segmentry.operators import metrics as M
from segmentry.operators import particles as PT
from segmentry.operators import trajectory as T
from segmentry.plans import views as V
from segmentry.plans.views import EMB, HORIZONS, PARTS, STEPS, query
from segmentry.sources.shared import sized
from segmentry.streaming import streams

EPISODES = "e AS (SELECT run, episode, sum(reward) AS reward, sum(true_reward) AS true_reward, max(CAST(success AS INT)) AS success, count(*) AS length FROM steps GROUP BY run, episode)"
HZ_EPISODES = EPISODES.replace("FROM steps", "FROM hz")


@query("A1_episode_summary", f"WITH {STEPS}, {EPISODES} SELECT * FROM e")
def _(spark, d):
    return M.episode_summary(V.steps(spark, d))


@query("A2_evaluation_summary", f"""WITH {STEPS}, {EPISODES}, l AS (SELECT run, arg_max(CAST(success AS INT), step) AS last_success FROM steps GROUP BY run)
SELECT run, round(avg(reward), 4) AS reward, round(avg(true_reward), 4) AS true_reward, round(avg(success) * 100, 4) AS success_rate, count(*) AS episodes, any_value(last_success) AS last_success FROM e JOIN l USING (run) GROUP BY run""")
def _(spark, d):
    rows = M.evaluation_summary(V.steps(spark, d))
    return rows.select("run", *(F.round(c, 4).alias(c) for c in ("reward", "true_reward", "success_rate")), "episodes", "last_success")


def _with_info(spark, d):
    info = F.create_map(F.lit("success"), F.col("success").cast("double"), F.lit("k"), F.col("true_reward"), F.lit("hour"), F.col("hour").cast("double"))
    return V.steps(spark, d).withColumn("info", info)


@query("A3_info_stats", f"""WITH {STEPS}, i AS (SELECT run, episode, t, 'success' AS key, CAST(success AS DOUBLE) AS v FROM steps UNION ALL SELECT run, episode, t, 'k', true_reward FROM steps),
f AS (SELECT run, episode, key, arg_max(v, t) AS last FROM i GROUP BY run, episode, key), m AS (SELECT key, avg(v) AS mean FROM i GROUP BY key)
SELECT key, round(any_value(mean), 6) AS mean, round(avg(last), 6) AS final_mean FROM f JOIN m USING (key) GROUP BY key""")
def _(spark, d):
    return M.info_stats(_with_info(spark, d), ["success", "k"]).select("key", F.round("mean", 6).alias("mean"), F.round("final_mean", 6).alias("final_mean"))


@query("A4_path_diagnostics", f"""WITH {STEPS}, f AS (SELECT arg_max(true_reward, t) AS x FROM steps GROUP BY run, episode)
SELECT (SELECT round(avg(true_reward), 6) FROM steps) AS mean, (SELECT round(stddev_pop(true_reward), 6) FROM steps) AS std, (SELECT max(true_reward) FROM steps) AS max, (SELECT min(true_reward) FROM steps) AS min,
  round(avg(x), 6) AS final_mean, round(stddev_pop(x), 6) AS final_std, max(x) AS final_max, min(x) AS final_min FROM f""")
def _(spark, d):
    rows = M.path_diagnostics(V.steps(spark, d), "true_reward")
    return rows.select(*(F.round(c, 6).alias(c) if c.endswith(("mean", "std")) else F.col(c) for c in rows.columns))


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("A5_meters", "WITH m AS (SELECT CAST(user_id % 3 AS VARCHAR) AS run_id, epoch(date_trunc('hour', ts)) // 3600 AS step, event_type AS key, round(value * 100) AS value FROM events) SELECT run_id, CAST(step AS BIGINT) AS step, " + ", ".join(f"round(coalesce(sum(value) FILTER (key = '{k}') / greatest(count(*) FILTER (key = '{k}'), 1), 0), 6) AS {k}" for k in KINDS) + " FROM m GROUP BY run_id, step")
def _(spark, d):
    rows = V.table(spark, d, "events").select((F.col("user_id") % 3).cast("string").alias("run_id"), F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("step"), M.meter_name(F.concat(F.lit("train/"), "event_type")).alias("key"), F.round(F.col("value") * 100).alias("value"), F.lit(1).alias("n"))
    return M.meters(rows, KINDS).select("run_id", "step", *(F.round(k, 6).alias(k) for k in KINDS))


OBS_SQL = f"""WITH {EMB}, x AS (SELECT id, unnest(range(0, 64)) AS dim, unnest(vec) AS x FROM emb), s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY dim)"""


@query("A9_observation_stats", OBS_SQL + " SELECT CAST(dim AS INT) AS dim, round(m, 6) AS mean, round(s, 6) AS std FROM s")
def _(spark, d):
    return M.obs_stats(V.embeddings(spark, d), "vec").select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("A9_normalised_observations", OBS_SQL + " SELECT id, round(sum(abs((x - m) / (s + 1e-8))), 4) AS total FROM x JOIN s USING (dim) GROUP BY id")
def _(spark, d):
    rows = V.embeddings(spark, d)
    out = M.normalise_obs(rows, M.obs_stats(rows, "vec"), "vec")
    return out.select("id", F.round(F.aggregate("normalised", F.lit(0.0), lambda a, x: a + F.abs(x)), 4).alias("total"))


@query("A10_merged_moments", f"""WITH {STEPS}, m AS (SELECT count(*) AS c, avg(reward) AS a, var_pop(reward) AS v FROM raw)
SELECT round(c + 0.0001, 4) AS n, round(a * c / (c + 0.0001), 3) AS mean, round((1.0 * 0.0001 + v * c + a * a * 0.0001 * c / (c + 0.0001)) / (c + 0.0001), 1) AS var FROM m""")
def _(spark, d):
    rows = V.raw_steps(spark, d).withColumn("batch", F.floor(F.col("step") / 128))
    out = M.merge_moments(rows, "batch", "reward")
    return out.select(F.round("n", 4).alias("n"), F.round("mean", 3).alias("mean"), F.round("var", 1).alias("var"))


@query("A14_distinct_goals", "WITH t AS (SELECT l_returnflag AS env, l_quantity AS a, l_discount AS b FROM lineitem) SELECT env, count(*) AS n, count(DISTINCT (a, b)) AS n_distinct, count(*) = count(DISTINCT (a, b)) AS ok FROM t GROUP BY env")
def _(spark, d):
    return M.distinct_goals(V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("env"), F.array("l_quantity", "l_discount").alias("rand_vec")))


@query("J9_task_split", "SELECT c_custkey, n_name AS env, n_regionkey < 2 AS test FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    nation = V.table(spark, d, "nation")
    rows = V.table(spark, d, "customer").join(sized(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("env"))
    train, test = M.split_by_task(rows, nation.where("n_regionkey < 2").select(F.col("n_name").alias("env")))
    return train.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True)))


@query("W7_moving_average", f"""WITH {STEPS}, {EPISODES}, n AS (SELECT run, episode, reward, row_number() OVER w AS i, count(*) OVER (PARTITION BY run) AS n, avg(reward) OVER (PARTITION BY run ORDER BY episode ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS a FROM e WINDOW w AS (PARTITION BY run ORDER BY episode))
SELECT run, episode, round(CASE WHEN i >= 10 AND n >= 10 THEN a ELSE reward END, 4) AS smooth FROM n""")
def _(spark, d):
    rows = M.moving_average(M.episode_summary(V.steps(spark, d)), 10, "reward", "episode")
    return rows.select("run", "episode", F.round("smooth", 4).alias("smooth"))


@query("W8_teacher_thresholds", f"""WITH {STEPS}, {EPISODES}, n AS (SELECT run, episode, row_number() OVER w AS i, sum(true_reward) OVER (PARTITION BY run ORDER BY episode ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s FROM e WINDOW w AS (PARTITION BY run ORDER BY episode))
SELECT run, episode, round(s / least(i + 1, 10) * 8 / 40 * 0.1, 6) AS threshold FROM n""")
def _(spark, d):
    rows = M.teacher_thresholds(M.episode_summary(V.steps(spark, d)), 8, 40, 0.1)
    return rows.select("run", "episode", F.round("threshold", 6).alias("threshold"))


@query("W9_normalised_performance", f"WITH {HORIZONS}, p AS (SELECT run, step, true_reward AS v, first_value(true_reward) OVER (PARTITION BY run, episode ORDER BY t) AS f FROM hz) SELECT run, step, round((v - f) / nullif(100 - f, 0), 6) AS normalised FROM p")
def _(spark, d):
    rows = M.normalised_performance(V.horizon(spark, d), F.lit(100.0), "true_reward")
    return rows.select("run", "step", F.round("normalised", 6).alias("normalised"))


EMA_SQL = """WITH RECURSIVE v AS MATERIALIZED (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, value AS x FROM events),
r AS (SELECT run, i, x, 0.1 * x AS m, 0.9 + 0.1 * pow(x - 0.1 * x, 2) AS s FROM v WHERE i = 1
  UNION ALL SELECT v.run, v.i, v.x, r.m + 0.1 * (v.x - r.m), 0.9 * r.s + 0.1 * pow(v.x - (r.m + 0.1 * (v.x - r.m)), 2) FROM r JOIN v ON v.run = r.run AND v.i = r.i + 1)
SELECT run, i AS step, round((x - m) / (sqrt(s) + 1e-8), 5) AS normalised FROM r"""


def _ema_rows(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    rows = T.numbered(V.table(spark, d, "events").select(F.col("user_id").alias("run"), "event_id", "value", k.alias("k")), "run", "event_id", "step")
    return rows.withColumn("step", F.col("step").cast("long") + 1)


def _ema(value: str, top: str, last: str = "") -> str:
    """SQL of one dimension, step by step along each run."""
    return f"""v{last} AS MATERIALIZED (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, {value} AS x FROM events),
r{last} AS (SELECT run, i, x, 0.1 * x AS m, 0.9 + 0.1 * pow(x - 0.1 * x, 2) AS s FROM v{last} WHERE i = 1
  UNION ALL SELECT v.run, v.i, v.x, r.m + 0.1 * (v.x - r.m), 0.9 * r.s + 0.1 * pow(v.x - (r.m + 0.1 * (v.x - r.m)), 2) FROM r{last} r JOIN v{last} v ON v.run = r.run AND v.i = r.i + 1),
n{last} AS (SELECT run, i AS step, round({top} / (sqrt(s) + 1e-8), 5) AS normalised FROM r{last})"""


EMA_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


@query("W10_ema_rewards", f"WITH RECURSIVE {_ema('value', 'x')} SELECT * FROM n")
def _(spark, d):
    return M.ema_normalise(_ema_rows(spark, d), 0.1, centred=False).select("run", "step", F.round("normalised", 5).alias("normalised"))


@query("W10_ema_vectors", f"WITH RECURSIVE {_ema('value', '(x - m)', '1')}, {_ema(EMA_K, '(x - m)', '2')} SELECT run, step, n1.normalised AS first, n2.normalised AS second FROM n1 JOIN n2 USING (run, step)")
def _(spark, d):
    rows = M.ema_normalise(_ema_rows(spark, d).withColumn("value", F.array("value", "k")), 0.1)
    return rows.select("run", "step", F.round(F.col("normalised")[0], 5).alias("first"), F.round(F.col("normalised")[1], 5).alias("second"))


@query("W10_ema_normaliser", EMA_SQL)
def _(spark, d):
    return M.ema_normalise(_ema_rows(spark, d), 0.1).select("run", "step", F.round("normalised", 5).alias("normalised"))


SESSIONS = """WITH s AS (SELECT user_id AS run, event_id, ts, round(value * 100) AS reward, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY run ORDER BY ts, event_id) AS s FROM s) SELECT run, epoch_us(min(ts)) AS start, sum(reward) AS reward, count(*) AS length FROM g GROUP BY run, s"""


@query("T3_session_windows", SESSIONS)
def _(spark, d):
    out = streams.stream_sessions(V.raw_steps(spark, d).withColumn("run", F.col("user_id")), "6 hours")
    return out.select("run", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', start)").alias("start"), "reward", "length")


GOAL = "goal AS (SELECT CAST(i AS BIGINT) AS particle_id, CAST(i AS DOUBLE) AS gx, 5.0 AS gy, 4.0 AS gz FROM (SELECT unnest(range(0, 20)) AS i))"


@query("J4_goal_distance", f"WITH {PARTS}, {GOAL} SELECT episode, t, round(avg(sqrt(pow(x - gx, 2) + pow(y - gy, 2) + pow(z - gz, 2))), 5) AS mean_distance, round(-10 * avg(sqrt(pow(x - gx, 2) + pow(y - gy, 2) + pow(z - gz, 2))), 4) AS reward FROM parts JOIN goal USING (particle_id) GROUP BY episode, t")
def _(spark, d):
    goal = spark.range(20).select(F.col("id").alias("particle_id"), F.col("id").cast("double").alias("gx"), F.lit(5.0).alias("gy"), F.lit(4.0).alias("gz"))
    out = PT.goal_distance(V.particles(spark, d), goal)
    return out.select("episode", "t", F.round("mean_distance", 5).alias("mean_distance"), F.round("reward", 4).alias("reward"))


@query("J5_points_in_box", f"WITH {PARTS}, b AS (SELECT *, t % 10 + 5 AS lo, t % 10 + 35 AS hi FROM parts) SELECT episode, t, count(*) FILTER (x BETWEEN lo AND hi AND y BETWEEN 1 AND 8 AND z BETWEEN 0 AND 6) AS n_inside, count(*) AS n FROM b GROUP BY episode, t")
def _(spark, d):
    rows = V.particles(spark, d)
    boxes = rows.select(*PT.STEP).distinct().selectExpr(*PT.STEP, "cast(t % 10 + 5 as double) x_lo", "cast(t % 10 + 35 as double) x_hi", "1.0D y_lo", "8.0D y_hi", "0.0D z_lo", "6.0D z_hi")
    return PT.count_in_box(rows, boxes).select("episode", "t", "n_inside", "n")


@query("J5_fill_share", f"WITH {PARTS}, s AS (SELECT episode, t, avg(CAST(x BETWEEN 5 AND 40 AND y BETWEEN 0 AND 8 AND z BETWEEN 0 AND 8 AND NOT (x BETWEEN 10 AND 20 AND y BETWEEN 2 AND 5 AND z BETWEEN 0 AND 8) AS DOUBLE)) AS share FROM parts GROUP BY episode, t) SELECT episode, t, round(share, 6) AS share, round(abs(share - 0.5), 6) AS deviation FROM s")
def _(spark, d):
    out = PT.fill_share(V.particles(spark, d), (5, 40, 0, 8, 0, 8), (10, 20, 2, 5, 0, 8), 0.5)
    return out.select("episode", "t", F.round("share", 6).alias("share"), F.round("deviation", 6).alias("deviation"))


def _one_a_step(spark, d):
    """A particle of each id in each step: the mean of those there are, so that ids are keys."""
    return V.particles(spark, d).groupBy(*PT.STEP, "particle_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"))


@query("J11_fold_distance", f"""WITH {PARTS}, o AS (SELECT run, episode, t, particle_id AS p, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM parts GROUP BY run, episode, t, p),
m AS (SELECT CAST(i AS BIGINT) AS a, CAST(19 - i AS BIGINT) AS b FROM (SELECT unnest(range(0, 10)) AS i)),
j AS (SELECT a.episode, a.t, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS fold, sqrt(pow(b.x - f.x, 2) + pow(b.y - f.y, 2) + pow(b.z - f.z, 2)) AS moved
  FROM o a JOIN m ON a.p = m.a JOIN o b ON b.p = m.b AND b.episode = a.episode AND b.t = a.t JOIN (SELECT * FROM o WHERE t = 0) f ON f.p = m.b AND f.episode = a.episode)
SELECT episode, t, round(avg(fold), 5) AS fold, round(avg(moved), 5) AS moved, round(-(avg(fold) + 1.2 * avg(moved)), 5) AS reward FROM j GROUP BY episode, t""")
def _(spark, d):
    mapping = spark.range(10).select(F.col("id").alias("a"), (19 - F.col("id")).alias("b"))
    out = PT.fold_distance(_one_a_step(spark, d), mapping)
    return out.select("episode", "t", *(F.round(c, 5).alias(c) for c in ("fold", "moved", "reward")))


@query("A13_covered_area", f"""WITH {PARTS}, e AS (SELECT episode, t, min(x) AS x0, min(z) AS z0, (max(x) - min(x)) / 100 AS dx, (max(z) - min(z)) / 100 AS dz FROM parts GROUP BY episode, t),
s AS (SELECT DISTINCT episode, t, dx, dz, CAST(greatest(round_even((x - x0 - 0.3) / dx, 0), 0) AS BIGINT) AS xl, CAST(least(round_even((x - x0 + 0.3) / dx, 0), 100) AS BIGINT) AS xh, CAST(greatest(round_even((z - z0 - 0.3) / dz, 0), 0) AS BIGINT) AS zl, CAST(least(round_even((z - z0 + 0.3) / dz, 0), 100) AS BIGINT) AS zh
  FROM parts JOIN e USING (episode, t) WHERE dx > 0 AND dz > 0),
i AS (SELECT episode, t, dx, dz, unnest(range(xl, xh + 1)) AS i, zl, zh FROM s), c AS (SELECT DISTINCT episode, t, dx, dz, i, unnest(range(zl, zh + 1)) AS j FROM i)
SELECT episode, t, count(DISTINCT least(i * 100 + j, 9999)) AS n_cells, round(count(DISTINCT least(i * 100 + j, 9999)) * any_value(dx) * any_value(dz), 4) AS area FROM c GROUP BY episode, t""")
def _(spark, d):
    return PT.covered_area(V.particles(spark, d), 0.3).select("episode", "t", "n_cells", F.round("area", 4).alias("area"))
