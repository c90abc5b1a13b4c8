"""Domain views of the tables, as DataFrames and as SQL for DuckDB.

steps: events by run (user_id % 3), in order of event_id, which is the order of time; reward in whole cents, so that sums are exact.
horizon: all steps of each user, 40 by 40, as trajectories; a user's last one is shorter. pairs: draws of two segments of 8 steps, one for each twentieth event.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmentry.operators import pairs as P
from segmentry.operators import trajectory as T
from segmentry.sources.shared import scratch  # noqa: F401

SEG, HORIZON, SEED, GAMMA = 8, 40, 7, 0.9
#: Numbers of trajectories that a user has at most.
EPISODES = 1_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).alias("run"), F.col("event_id").alias("step"), "user_id", "ts", "event_type",
        F.round(F.col("value") * 100).alias("reward"), k.cast("double").alias("true_reward"), k.alias("k"), F.hour("ts").cast("long").alias("hour"),
        (F.col("event_type") == "purchase").alias("done"), (F.col("event_type") == "signup").alias("success"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.assemble_episodes(raw_steps(spark, sf_dir))


def horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.numbered(raw_steps(spark, sf_dir), "user_id", "step", "n")
    return rows.withColumn("episode", F.col("user_id") * EPISODES + F.floor(F.col("n") / HORIZON)).withColumn("t", (F.col("n") % HORIZON).cast("int")).drop("n")


def drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs, and the steps that they draw from."""
    rows = horizon(spark, sf_dir)
    n = table(spark, sf_dir, "events").count() // 20
    return P.sample_pairs(P.trajectory_lengths(rows), n, SEG, SEED), rows


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, rows = drawn(spark, sf_dir)
    return P.segment_returns(P.gather_steps(pairs, rows, SEG, ["reward"]), SEG, GAMMA)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    key = [F.col("l_orderkey") % 7, F.col("l_orderkey") % 50]
    return rows.select(
        F.lit(0).cast("long").alias("run"), key[0].alias("episode"), key[1].cast("int").alias("t"), (F.col("l_partkey") % 20).alias("particle_id"),
        F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"), F.round(F.col("l_tax") * 100).alias("z"),
    )


def score_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query log: prices of an order as the two scores, in cents, and a drawn label."""
    from segmentry.functions import draws

    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("pair_id"), (F.col("o_custkey") % 10).cast("int").alias("train_iter"), F.round(F.col("o_totalprice") * 100).alias("score_1"),
        F.round(F.col("o_totalprice") * 100 * (F.col("o_orderkey") % 5 + 1) / 3).alias("score_2"), (draws.index("label", 3, F.col("o_orderkey")) - 1).cast("int").alias("label"),
    )


def u(seed: str, key: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}|' || {key}), 1, 13) AS BIGINT)::DOUBLE / {float(1 << 52)!r}::DOUBLE)"


STEPS = """raw AS (
  SELECT user_id % 3 AS run, event_id AS step, user_id, ts, event_type, round(value * 100) AS reward, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS true_reward, hour(ts) AS hour, event_type = 'purchase' AS done, event_type = 'signup' AS success FROM events),
closed AS (SELECT *, CAST(coalesce(sum(CAST(done AS INT)) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS episode FROM raw),
steps AS (SELECT *, CAST(row_number() OVER (PARTITION BY run, episode ORDER BY step) - 1 AS INT) AS t FROM closed)"""
HORIZONS = STEPS + f""",
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step) - 1 AS n FROM raw),
hz AS (SELECT run, step, user_id, user_id * {EPISODES} + n // {HORIZON} AS episode, reward, true_reward, k, hour, done, success, CAST(n % {HORIZON} AS INT) AS t FROM placed),
traj AS (SELECT run, episode, count(*) AS length, row_number() OVER (ORDER BY run, episode) - 1 AS traj FROM hz GROUP BY run, episode)"""
# Segments are drawn among the trajectories that have room for one.
PAIRS = HORIZONS + f""",
pid AS (SELECT unnest(range(0, CAST((SELECT count(*) FROM events) AS BIGINT) // 20)) AS pair_id),
room AS (SELECT run, episode, length, row_number() OVER (ORDER BY traj) - 1 AS i FROM traj WHERE length > {SEG}),
d AS (SELECT pair_id, floor({u(f'{SEED}|traj1', 'pair_id')} * (SELECT count(*) FROM room)) AS i1, floor({u(f'{SEED}|traj2', 'pair_id')} * (SELECT count(*) FROM room)) AS i2 FROM pid),
pairs AS (SELECT d.pair_id, a.run AS run_1, a.episode AS episode_1, CAST(floor({u(f'{SEED}|start1', 'd.pair_id')} * (a.length - {SEG})) AS BIGINT) AS start_1,
  b.run AS run_2, b.episode AS episode_2, CAST(floor({u(f'{SEED}|start2', 'd.pair_id')} * (b.length - {SEG})) AS BIGINT) AS start_2
  FROM d JOIN room a ON d.i1 = a.i JOIN room b ON d.i2 = b.i),
sides AS (SELECT pair_id, 1 AS side, run_1 AS run, episode_1 AS episode, start_1 AS start FROM pairs UNION ALL SELECT pair_id, 2, run_2, episode_2, start_2 FROM pairs),
gathered AS (SELECT s.pair_id, s.side, s.start, h.t, h.reward FROM sides s JOIN hz h ON s.run = h.run AND s.episode = h.episode AND h.t BETWEEN s.start AND s.start + {SEG - 1}),
ret AS (SELECT pair_id, side, sum(reward) AS total, sum(reward * pow({GAMMA}, {SEG - 1} - (t - start))) AS discounted FROM gathered GROUP BY pair_id, side),
pr AS (SELECT pair_id, max(total) FILTER (side = 1) AS sum_1, max(total) FILTER (side = 2) AS sum_2, max(discounted) FILTER (side = 1) AS g_1, max(discounted) FILTER (side = 2) AS g_2 FROM ret GROUP BY pair_id)"""
EMB = "emb AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"
PARTS = """parts AS (SELECT CAST(0 AS BIGINT) AS run, l_orderkey % 7 AS episode, CAST(l_orderkey % 50 AS INT) AS t, l_partkey % 20 AS particle_id, l_quantity AS x, round(l_discount * 100) AS y, round(l_tax * 100) AS z FROM lineitem)"""
LOG = f"""log AS (SELECT o_orderkey AS pair_id, CAST(o_custkey % 10 AS INT) AS train_iter, round(o_totalprice * 100) AS score_1, round(o_totalprice * 100 * (o_orderkey % 5 + 1) / 3) AS score_2,
  CAST(floor({u('label', 'o_orderkey')} * 3) - 1 AS INT) AS label FROM orders)"""
