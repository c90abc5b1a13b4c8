"""Queries of the step, pair and segment operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from segmentry.functions import preference, rewards
from segmentry.functions.draws import index
from segmentry.operators import pairs as P
from segmentry.operators import trajectory as T
from segmentry.plans import views as V
from segmentry.plans.views import EMB, GAMMA, HORIZONS, LOG, PAIRS, SEED, SEG, STEPS, query, u
from segmentry.sources import logs


@query("W1_assemble_episodes", f"WITH {STEPS} SELECT run, step, episode, t FROM steps")
def _(spark, d):
    return V.steps(spark, d).select("run", "step", "episode", "t")


@query("W2_last_episodes", f"WITH {STEPS} SELECT run, step, episode FROM steps JOIN (SELECT run, max(episode) AS m FROM steps GROUP BY run) USING (run) WHERE episode > m - 100")
def _(spark, d):
    return T.last_episodes(V.steps(spark, d), 100).select("run", "step", "episode")


@query("W3_ring_buffer", f"WITH {STEPS} SELECT step, run, reward FROM raw ORDER BY step DESC LIMIT 2000")
def _(spark, d):
    return T.last_rows(V.raw_steps(spark, d), 2000, "step").select("step", "run", "reward")


@query("W4_complete_trajectories", f"""WITH {STEPS}, l AS (SELECT run, episode, count(*) AS n FROM steps GROUP BY run, episode), f AS (SELECT run, arg_min(n, episode) AS n FROM l GROUP BY run)
SELECT s.run, s.episode, s.t, s.step FROM steps s JOIN l USING (run, episode) JOIN f ON f.run = s.run AND f.n = l.n""")
def _(spark, d):
    return T.complete_trajectories(V.steps(spark, d)).select("run", "episode", "t", "step")


@query("W5_segments", f"""WITH {HORIZONS}, w AS (SELECT run, episode, t AS start, list(reward) OVER (PARTITION BY run, episode ORDER BY t ROWS BETWEEN CURRENT ROW AND {SEG - 1} FOLLOWING) AS r, count(*) OVER (PARTITION BY run, episode) AS n FROM hz)
SELECT run, episode, start, r[1] AS first, list_sum(r) AS total, len(r) AS n FROM w WHERE start < n - {SEG}""")
def _(spark, d):
    rows = T.segments(V.horizon(spark, d), SEG, ["reward"])
    return rows.select("run", "episode", "start", F.col("steps")[0]["reward"].alias("first"), F.aggregate("steps", F.lit(0.0), lambda a, x: a + x["reward"]).alias("total"), F.size("steps").cast("long").alias("n"))


@query("W6_frame_stack", f"""WITH {STEPS}, o AS (SELECT run, step, episode, t, reward AS a, CAST(k AS DOUBLE) AS b FROM steps)
SELECT run, step, concat_ws(',', CAST(a AS BIGINT), CAST(b AS BIGINT), CAST(coalesce(lag(a) OVER w, a) AS BIGINT), CAST(coalesce(lag(b) OVER w, b) AS BIGINT), 0) AS stacked FROM o WINDOW w AS (PARTITION BY run, episode ORDER BY t)""")
def _(spark, d):
    rows = V.steps(spark, d).withColumn("obs", F.array("reward", F.col("k").cast("double"))).withColumn("goal", F.array(F.col("hour").cast("double")))
    stacked = T.frame_stack(rows, observable=False)
    return stacked.select("run", "step", F.concat_ws(",", F.transform("stacked", lambda x: x.cast("long").cast("string"))).alias("stacked"))


@query("P1_parse_observation", f"WITH {EMB} SELECT id, vec[4] AS gripper, list_sum(vec[1:3]) AS hand, list_sum(vec[5:7]) AS object, CAST(len(vec[8:61]) AS INTEGER) AS n_rest, list_sum(vec[62:64]) AS goal FROM emb")
def _(spark, d):
    rows = V.embeddings(spark, d)
    parts = T.parse_observation(F.col("vec"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return rows.select("id", parts["gripper"].alias("gripper"), add(parts["hand"]).alias("hand"), add(parts["object"]).alias("object"), F.size(parts["rest"]).alias("n_rest"), add(parts["goal"]).alias("goal"))


@query("P2_state_action", f"WITH {STEPS} SELECT step, concat_ws(',', CAST(reward AS BIGINT), k, hour, CAST(round((k / 50.0 - 1) * 100) AS BIGINT)) AS sa FROM raw")
def _(spark, d):
    rows = V.raw_steps(spark, d)
    obs = F.array("reward", F.col("k").cast("double"), F.col("hour").cast("double"))
    sa = T.state_action(obs, F.array(F.round((F.col("k") / 50.0 - 1) * 100)))
    return rows.select("step", F.concat_ws(",", F.transform(sa, lambda x: x.cast("long").cast("string"))).alias("sa"))


@query("P3_rescale_action", f"WITH {STEPS} SELECT step, round(greatest(0.0, least(10.0, (k / 40.0 - 1 + 1) / 2 * 10)), 6) AS action FROM raw")
def _(spark, d):
    rows = V.raw_steps(spark, d)
    return rows.select("step", F.round(T.rescale_action(F.array(F.col("k") / 40.0 - 1), 0.0, 10.0)[0], 6).alias("action"))


@query("P4_done_flags", f"WITH {STEPS} SELECT step, CASE WHEN t + 1 = 5 THEN false ELSE done END AS done_no_max, CAST(NOT done AS INT) AS not_done, CAST(NOT CASE WHEN t + 1 = 5 THEN false ELSE done END AS INT) AS not_done_no_max FROM steps")
def _(spark, d):
    return T.done_flags(V.steps(spark, d), 5).select("step", "done_no_max", "not_done", "not_done_no_max")


@query("P5_select_reward", f"WITH {STEPS} SELECT step, reward AS learned, -(2 * (k / 100.0) - 1) AS clip, 2 * (k / 100.0) - 1 AS blip, true_reward AS truth, CAST(success AS DOUBLE) AS sparse FROM raw")
def _(spark, d):
    share = F.col("k") / F.lit(100.0)
    pick = lambda mode, flip=False: T.select_reward(mode, F.col("reward"), share, share, F.col("true_reward"), F.col("success"), flip).alias(mode)
    return V.raw_steps(spark, d).select("step", pick("learned"), pick("clip", True), pick("blip"), pick("truth"), pick("sparse"))


@query("P6_skip_low_return", f"WITH {PAIRS} SELECT pair_id, sum_1, sum_2 FROM pr WHERE greatest(sum_1, sum_2) > 30000")
def _(spark, d):
    return P.skip_low_return(P.pair_returns(V.returns(spark, d)), 30000).select("pair_id", "sum_1", "sum_2")


def _image_pairs(spark, d):
    rows = V.embeddings(spark, d)
    n = rows.count()
    pairs = rows.select(F.col("id").alias("pair_id"), F.col("vec").alias("image_1"), index("other", n, F.col("id")).alias("o"))
    pairs = pairs.withColumn("o", F.when(F.col("pair_id") % 4 == 0, F.col("pair_id")).otherwise(F.col("o")))
    met = pairs.join(rows.select(F.col("id").alias("o"), F.col("vec").alias("image_2")), "o")
    label = (index("label", 3, F.col("pair_id")) - 1).cast("int")
    return met.select("pair_id", "image_1", "image_2", label.alias("label"), P.useful(F.col("image_1"), F.col("image_2")).alias("useful"))


IMAGES = f"""{EMB}, o AS (SELECT id, vec, CASE WHEN id % 4 = 0 THEN id ELSE CAST(floor({u('other', 'id')} * (SELECT count(*) FROM emb)) AS BIGINT) END AS o FROM emb),
ip AS (SELECT o.id AS pair_id, CAST(floor({u('label', 'o.id')} * 3) - 1 AS INT) AS label, o.vec <> e.vec AS useful FROM o JOIN emb e ON o.o = e.id)"""


@query("P7_drop_identical", f"WITH {IMAGES} SELECT pair_id, useful FROM ip")
def _(spark, d):
    return _image_pairs(spark, d).select("pair_id", "useful")


@query("P8_training_and_log_filter", f"WITH {IMAGES} SELECT pair_id, 'good' AS kind FROM ip WHERE label <> -1 AND useful UNION ALL SELECT pair_id, 'log' FROM ip WHERE label = -1 OR useful")
def _(spark, d):
    rows = _image_pairs(spark, d)
    return P.good_pairs(rows).select("pair_id", F.lit("good").alias("kind")).unionByName(P.loggable_pairs(rows).select("pair_id", F.lit("log").alias("kind")))


@query("P9_flip_labels", f"WITH {IMAGES} SELECT pair_id, 1 - label AS label FROM ip WHERE label <> -1 AND useful")
def _(spark, d):
    return P.good_pairs(_image_pairs(spark, d)).select("pair_id", P.flip_label(F.col("label")).alias("label"))


@query("P10_state_rewards", f"""WITH {STEPS}, s AS (SELECT step, (k - 50) / 300.0 AS theta, reward / 1000.0 AS d, k AS out, hour / 24.0 AS x FROM raw)
SELECT step, round(-abs(degrees(theta)), 6) AS pole, abs(degrees(theta)) < 5 AS pole_ok, round(least(d, 2.2), 6) AS rope, least(d, 2.2) >= 1.9 AS rope_ok,
  round(-(out / 100.0) - abs(0.5 - x), 6) AS water, round(-(out / 100.0) - abs(0.5 - x), 6) > -0.36 AS water_ok FROM s""")
def _(spark, d):
    theta, dist = (F.col("k") - 50) / 300.0, F.col("reward") / 1000.0
    water = F.round(rewards.water_reward(F.col("k"), F.lit(100), F.col("hour") / 24.0, F.lit(0.5)), 6)
    return V.raw_steps(spark, d).select(
        "step", F.round(rewards.pole_reward(theta), 6).alias("pole"), rewards.pole_success(theta).alias("pole_ok"), F.round(rewards.rope_reward(dist, 2.0), 6).alias("rope"),
        rewards.rope_success(dist, 2.0).alias("rope_ok"), water.alias("water"), rewards.water_success(water).alias("water_ok"),
    )


@query("J1_sample_pairs", f"WITH {PAIRS} SELECT * FROM pairs")
def _(spark, d):
    return V.drawn(spark, d)[0]


@query("J1_segments_from_the_start", f"""WITH {HORIZONS}, pid AS (SELECT unnest(range(0, CAST((SELECT count(*) FROM events) AS BIGINT) // 20)) AS pair_id),
room AS (SELECT run, episode, row_number() OVER (ORDER BY traj) - 1 AS i FROM traj WHERE length >= {SEG}),
d AS (SELECT pair_id, floor({u(f'{SEED}|traj1', 'pair_id')} * (SELECT count(*) FROM room)) AS i1, floor({u(f'{SEED}|traj2', 'pair_id')} * (SELECT count(*) FROM room)) AS i2 FROM pid)
SELECT pair_id, a.run AS run_1, a.episode AS episode_1, CAST(0 AS BIGINT) AS start_1, b.run AS run_2, b.episode AS episode_2, CAST(0 AS BIGINT) AS start_2 FROM d JOIN room a ON d.i1 = a.i JOIN room b ON d.i2 = b.i""")
def _(spark, d):
    rows = V.horizon(spark, d)
    return P.sample_pairs(P.trajectory_lengths(rows), V.table(spark, d, "events").count() // 20, SEG, SEED, from_start=True)


@query("J2_attach_frames", f"""WITH {PAIRS} SELECT s.pair_id AS segment_id, string_agg(CAST(h.step AS VARCHAR), ',' ORDER BY h.t) AS frames FROM sides s
JOIN hz h ON s.side = 1 AND s.run = h.run AND s.episode = h.episode AND h.t IN (s.start + 1, s.start + 3, s.start + 5, s.start + 7) GROUP BY s.pair_id""")
def _(spark, d):
    pairs, rows = V.drawn(spark, d)
    segments = pairs.select(F.col("pair_id").alias("segment_id"), F.col("run_1").alias("run"), F.col("episode_1").alias("episode"), F.col("start_1").alias("start"))
    found = P.attach_frames(segments, rows.withColumn("frame", F.col("step").cast("string")), SEG, 4)
    return found.select("segment_id", F.concat_ws(",", "frames").alias("frames"))


@query("J7_cached_labels", f"WITH {PAIRS}, cache AS (SELECT doc_id AS pair_id, quality AS label FROM labels) SELECT p.pair_id, c.label FROM pairs p LEFT JOIN cache c USING (pair_id)")
def _(spark, d):
    pairs = V.drawn(spark, d)[0].select("pair_id")
    cache = V.table(spark, d, "labels").select(F.col("doc_id").alias("pair_id"), F.col("quality").alias("label"))
    rest = P.unlabelled(pairs, cache).withColumn("label", F.lit(None).cast("int"))
    return P.cached_labels(pairs, cache).select("pair_id", "label").unionByName(rest)


@query("J10_asof_version", f"""WITH {STEPS}, up AS (SELECT run, step, step // 100 AS version FROM raw WHERE event_type = 'error')
SELECT r.run, r.step, u.version FROM raw r ASOF LEFT JOIN up u ON r.run = u.run AND r.step >= u.step""")
def _(spark, d):
    rows = V.raw_steps(spark, d).select("run", "step", "event_type")
    updates = rows.where("event_type = 'error'").select("run", "step", F.floor(F.col("step") / 100).alias("version"))
    return T.asof_version(rows, updates).select("run", "step", "version")


@query("A6_segment_returns", f"WITH {PAIRS} SELECT pair_id, side, total, round(discounted, 4) AS discounted FROM ret")
def _(spark, d):
    return V.returns(spark, d).withColumn("discounted", F.round("discounted", 4))


TEACHER = f"""CASE WHEN abs(sum_1 - sum_2) < 500 THEN -1 WHEN {u('3|mistake', 'pair_id')} < 0.1 THEN 1 - lab ELSE lab END"""


@query("F10_teacher_label", f"""WITH {PAIRS}, l AS (SELECT *, CASE WHEN round(g_1, 4) < round(g_2, 4) THEN 1 ELSE 0 END AS lab FROM pr)
SELECT pair_id, lab AS rational_label, {TEACHER} AS label FROM l""")
def _(spark, d):
    rows = P.pair_returns(V.returns(spark, d))
    g1, g2 = F.round("g_1", 4), F.round("g_2", 4)
    label = preference.teacher_label(g1, g2, F.col("sum_1"), F.col("sum_2"), F.col("pair_id"), eps_mistake=0.1, thres_equal=500.0, seed=3)
    return rows.select("pair_id", preference.rational_label(g1, g2).alias("rational_label"), label.alias("label"))


@query("U1_append_labels", f"WITH {LOG}, a AS (SELECT pair_id AS arrival, label FROM log WHERE pair_id % 3 = 0 UNION ALL SELECT pair_id, label FROM log WHERE pair_id % 3 = 1) SELECT arrival, label FROM a ORDER BY arrival DESC LIMIT 1000")
def _(spark, d):
    rows = V.score_log(spark, d).select(F.col("pair_id").alias("arrival"), "label")
    return P.append_labels(rows.where("arrival % 3 = 0"), rows.where("arrival % 3 = 1"), 1000)


@query("K6_sample_transitions", f"""WITH {STEPS}, p AS (SELECT i AS draw, CAST(floor({u('11', 'i')} * (SELECT count(*) FROM raw)) AS BIGINT) AS idx FROM (SELECT unnest(range(0, CAST((SELECT count(*) FROM events) AS BIGINT) // 10)) AS i))
SELECT draw, idx, run, reward FROM p JOIN (SELECT row_number() OVER (ORDER BY step) - 1 AS idx, run, reward FROM raw) USING (idx)""")
def _(spark, d):
    rows = T.dense_index(V.raw_steps(spark, d).select("step", "run", "reward"), ["step"])
    n = rows.count()
    return T.sample_transitions(rows, n // 10, 11, total=n).select("draw", "idx", "run", "reward")


@query("K7_member_batches", f"""WITH m AS (SELECT unnest(range(0, 3)) AS member), e AS (SELECT member, o_orderkey AS id, md5('5|' || member || '|' || o_orderkey) AS g FROM orders, m)
SELECT CAST(member AS INT) AS member, id, CAST((row_number() OVER (PARTITION BY member ORDER BY g, id) - 1) // 128 AS BIGINT) AS batch FROM e""")
def _(spark, d):
    return P.member_batches(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), 3, 128, 5)


_SHARE = {"constant": "1.0", "linear": "CASE WHEN total - began = 0 THEN 0.01 ELSE (total - began) / total END", "growing": "total / (total - began + 1)"}


@query("K8_feedback_budget", "WITH n AS (SELECT CAST(count(*) AS DOUBLE) AS total FROM events), " + ", ".join(
    f"""r_{name} AS (SELECT '{name}' AS schedule, round, CAST(trunc(40 * {share}) AS BIGINT) AS requested FROM (SELECT i AS round, CAST(i * 100 AS DOUBLE) AS began, total FROM n, unnest(range(0, CAST((SELECT max(event_id) FROM events) AS BIGINT) // 100 + 1)) t(i)))"""
    for name, share in _SHARE.items()
) + f""", r AS ({" UNION ALL ".join(f"SELECT * FROM r_{name}" for name in _SHARE)}), b AS (SELECT *, coalesce(sum(requested) OVER (PARTITION BY schedule ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT schedule, round, requested, CAST(greatest(0, least(requested, 1000 - before)) AS BIGINT) AS granted, CAST(least(1000, before + requested) AS BIGINT) AS used FROM b""")  # fmt: skip
def _(spark, d):
    """A round for each hundred steps, each schedule with its own budget of 1000 labels."""
    events = V.table(spark, d, "events")
    total, newest = events.agg(F.count("*"), F.max("event_id")).first()
    rounds = spark.range(newest // 100 + 1).select(F.col("id").alias("round"))
    out = None
    for schedule in ("constant", "linear", "growing"):
        rows = rounds.withColumn("requested", P.scheduled_size(40, (F.col("round") * 100).cast("double"), total, schedule))
        rows = P.apply_budget(rows, 1000).select(F.lit(schedule).alias("schedule"), "round", "requested", "granted", "used")
        out = rows if out is None else out.unionByName(rows)
    return out


FILES = """f AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'actor_' WHEN 1 THEN 'critic_' WHEN 2 THEN 'critic_target_' WHEN 3 THEN 'reward_model_' ELSE 'notes_' END || CAST(o_custkey * 10 + o_orderkey % 7 AS VARCHAR)
  || CASE WHEN o_orderkey % 5 = 3 THEN '_' || CAST(o_orderkey % 3 AS VARCHAR) ELSE '' END || '.pt' AS path FROM orders)"""


@query("S6_latest_checkpoint", rf"""WITH {FILES}, p AS (SELECT path, regexp_extract(path, '^(actor|critic_target|critic|reward_model)_', 1) AS kind, CAST(regexp_extract(path, '_(\d+)(_\d+)?\.pt$', 1) AS BIGINT) AS step, CAST(coalesce(nullif(regexp_extract(path, '_\d+_(\d+)\.pt$', 1), ''), '-1') AS INT) AS member FROM f)
SELECT kind, member, max(step) AS step, max_by(path, step) AS path FROM p WHERE kind <> '' GROUP BY kind, member""")
def _(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.element_at(F.array(*map(F.lit, ("actor_", "critic_", "critic_target_", "reward_model_", "notes_"))), (k % 5 + 1).cast("int"))
    tail = F.when(k % 5 == 3, F.concat(F.lit("_"), (k % 3).cast("string"))).otherwise("")
    files = V.table(spark, d, "orders").select(F.concat(kind, (c * 10 + k % 7).cast("string"), tail, F.lit(".pt")).alias("path"))
    return logs.latest_checkpoint(files)
