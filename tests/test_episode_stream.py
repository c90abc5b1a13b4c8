"""T1's stream: runs are cut into chunks, whose steps don't go to the run's own task."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from segmentry.plans import models
from segmentry.streaming import streams


def test_parts_of_chunks_are_those_of_a_loop():
    rng = np.random.default_rng(5)
    chunks = [[{"step": int(s), "reward": float(rng.integers(0, 9)), "done": bool(rng.random() < p)} for s in rng.permutation(n)] for n, p in ((1, 0), (1, 1), (40, 0), (40, 0.2), (7, 1), (300, 0.05))]
    kind = pa.list_(pa.struct([("step", pa.int64()), ("reward", pa.float64()), ("done", pa.bool_())]))
    columns = [pa.array(range(len(chunks)), pa.int64())] * 3 + [pa.array(chunks, kind)]
    got = [r for b in streams._parts(iter([pa.RecordBatch.from_arrays(columns, ["run", "at", "last", "steps"])])) for r in b.to_pylist()]
    for chunk, row in zip(chunks, got, strict=True):
        rewards, lengths = [], []
        new = True
        for s in sorted(chunk, key=lambda s: s["step"]):
            if new:
                rewards.append(0.0)
                lengths.append(0)
            rewards[-1], lengths[-1], new = rewards[-1] + s["reward"], lengths[-1] + 1, s["done"]
        assert (row["rewards"], row["lengths"], row["open"]) == (rewards, lengths, not new)


def test_steps_of_a_run_are_grouped_by_chunk_first(spark):
    steps = spark.readStream.format("rate").load().selectExpr("value % 3 run", "value step", "timestamp ts", "1D reward", "false done")
    plan = str(streams.stream_episodes(steps)._jdf.queryExecution().analyzed().toString())
    state = plan.index("TransformWithState")
    assert state < plan.index("MapInArrow") < plan.index("Aggregate")
    assert "steps#" not in plan[: plan.index("MapInArrow")]


def test_settings_of_keyed_state_come_back(spark):
    names = ["spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"]
    before, kept = [spark.conf.get(n, None) for n in names], spark.conf.get(names[0])
    spark.conf.set(names[0], "5000")
    try:
        with streams.keyed_state(spark):
            assert int(spark.conf.get(names[0])) <= max(8, spark.sparkContext.defaultParallelism)
        assert spark.conf.get(names[0]) == "5000"
    finally:
        spark.conf.set(names[0], kept)
    assert [spark.conf.get(n, None) for n in names] == before


def test_parts_of_a_stream_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(i):
        seen.add(1)
        return i

    rows = spark.range(100, numPartitions=2).select((F.col("id") % 2).cast("string").alias("key"), F.col("id").cast("double").alias("value"), counted.asNondeterministic()("id").alias("order"))
    found = models._streamed(spark, rows, streams.stream_moments, "update", files=5)
    assert {(r.key, r.n) for r in found.groupBy("key").agg(F.max("n").alias("n")).collect()} == {("0", 50), ("1", 50)}
    assert seen.value <= 200  # for the bounds, and to write


def test_an_idle_run_begins_anew(spark):
    from tests.test_jobs import BEAT, fed

    got = fed(spark, [[(0, 1, 0.1, 1.0, True), (0, 2, 0.2, 2.0, False)], [(1, 1, 50.0, 1.0, False)], [(0, 3, 60.0, 4.0, False), (0, 4, 63.5, 1.0, True)], BEAT], idle_ms=10 * 3_600_000)
    assert got == [(0, 0, 1.0, 1, True), (0, 0, 5.0, 2, True), (0, 1, 2.0, 1, False), (1, 0, 1.0, 1, False)]
