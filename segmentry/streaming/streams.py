"""Streams: episodes, meters, sessions, label ingest, running moments.

Each takes a streaming DataFrame and gives one; on a batch DataFrame, where noted, the same call gives the batch result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from segmentry.functions.replies import parse_preference

#: Of a run's steps in a chunk of time, in order: parts of episodes, each but the last with its end, which the last lacks if open.
PARTS = "run long, at long, last long, rewards array<double>, lengths array<long>, open boolean"
#: Episodes in a row, the number of the first, and whether they have their ends.
EPISODES = "run long, first long, rewards array<double>, lengths array<long>, ended boolean"


#: MB of blocks and unwritten rows that the stores of an executor hold, and partitions of a state where there are fewer cores.
STATE_MB, LEAST_TASKS = 256, 8


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """For the start of queries whose state is a processor's: the session's state store is RocksDB inside, and what it was afterwards. A query keeps what it was started with.

    Every batch commits every partition's stores, those without rows too, so there are no more partitions than cores, or LEAST_TASKS, and commits write changes, not whole stores. The stores of an
    executor, those of ended runs too, share STATE_MB for blocks and unwritten rows, and don't take 4 MB of disk each beforehand.
    """
    conf = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(STATE_MB),
        "spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(LEAST_TASKS, spark.sparkContext.defaultParallelism))),
    }
    before = {name: spark.conf.get(name, None) for name in conf}
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PARTS of chunks (run, at, last, steps); a task holds a batch of chunks, as numbers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("steps")
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        step, reward, done = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
        order = np.lexsort((done, reward, step, row))
        row, reward, done = row[order], reward[order], done[order]
        starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | done[:-1]])
        lengths = np.diff(np.r_[starts, len(row)])
        ends = np.cumsum(np.bincount(row[starts], minlength=len(lists)))
        offsets = pa.array(np.r_[0, ends].astype(np.int32))
        totals = pa.array(np.add.reduceat(reward, starts))
        is_open = ~done[starts + lengths - 1][ends - 1]
        columns = [batch.column("run"), batch.column("at"), batch.column("last"), pa.ListArray.from_arrays(offsets, totals), pa.ListArray.from_arrays(offsets, pa.array(lengths.astype(np.int64))), pa.array(is_open)]
        yield pa.RecordBatch.from_arrays(columns, ["run", "at", "last", "rewards", "lengths", "open"])


class Episodes(StatefulProcessor):
    """Of a run: the number and the sums of its open episode, which goes on through its chunks in their order."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "episode long, reward double, length long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        chunks = sorted((c for batch in rows for c in batch[["at", "last", "rewards", "lengths", "open"]].itertuples(index=False)), key=lambda c: c[0])
        begun = self.open.exists()
        episode, total, length, last = self.open.get() if begun else (0, 0.0, 0, None)
        out = []
        for _, newest, rewards, lengths, is_open in chunks:
            rewards, lengths = np.array(rewards, float), np.array(lengths, np.int64)
            rewards[0] += total
            lengths[0] += length
            n = len(rewards) - bool(is_open)
            total, length = (float(rewards[-1]), int(lengths[-1])) if is_open else (0.0, 0)
            if n:
                out.append((key[0], episode, rewards[:n], lengths[:n], True))
            episode, last = episode + n, int(newest) if last is None else max(last, int(newest))
        if last is not None:
            self.open.update((int(episode), float(total), int(length), int(last)))
            if not begun:
                self.handle.registerTimer(last + self.idle_ms)
        yield _episodes(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        out = []
        if self.open.exists():
            episode, total, length, last = self.open.get()
            if last + self.idle_ms > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(last + self.idle_ms)
            else:
                if length:
                    out.append((key[0], episode, np.array([total]), np.array([length]), False))
                self.open.clear()
        yield _episodes(out)

    def close(self) -> None:
        pass


def _episodes(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["run", "first", "rewards", "lengths", "ended"])


def stream_episodes(steps: DataFrame, watermark: str = "1 hour", idle_ms: int = 3_600_000, chunk_ms: int = 3_600_000) -> DataFrame:
    """(run, episode, reward, length, ended) as episodes close; steps are (run, step, ts, reward, done).

    Steps wait, by run and chunk of time, until the watermark has passed the chunk, and then join their episodes in order of step: those that come in any order, over any
    batches, give the same episodes as long as none is later than the watermark allows (such steps are dropped, as by any operator with a watermark). Times must
    not fall as steps rise. A run idle for so long past its last step, and a chunk more, gives its open episode with ended false, and counts from episode 0 if it goes on. A null
    reward is 0, a null done false; a step without a time is dropped. Start the query inside `keyed_state`.

    Chunks are grouped by Spark and cut at the ends of episodes in tasks of their own, so that a run of any length is many tasks. Only sums go to the run's own task, which numbers
    its episodes. The state is the steps of chunks that the watermark hasn't passed, and four numbers a run.
    """
    reward, done = F.coalesce(F.nanvl(F.col("reward").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("reward"), F.coalesce("done", F.lit(False)).alias("done")
    chunks = steps.withWatermark("ts", watermark).groupBy("run", F.window("ts", f"{chunk_ms} milliseconds").alias("w")).agg(F.max("ts").alias("last"), F.collect_list(F.struct("step", reward, done)).alias("steps"))
    parts = chunks.select("run", F.unix_millis("w.start").alias("at"), F.unix_millis("last").alias("last"), "steps").mapInArrow(_parts, PARTS)
    rows = parts.groupBy("run").transformWithStateInPandas(Episodes(idle_ms + chunk_ms), EPISODES, "Append", "EventTime")
    each = rows.select("run", "first", "ended", F.posexplode(F.arrays_zip("rewards", "lengths")).alias("i", "e"))
    return each.select("run", (F.col("first") + F.col("i")).alias("episode"), F.col("e.rewards").alias("reward"), F.col("e.lengths").alias("length"), "ended")


def stream_meters(metrics: DataFrame, window: str = "1 hour", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """(start, key, value): sum of values over sum of n for each window; rows later than the watermark are dropped. Also for batches."""
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    rows = metrics.withWatermark("ts", watermark).groupBy(at.alias("w"), "key")
    return rows.agg((F.sum("value") / F.greatest(F.sum("n"), F.lit(1))).alias("value")).select(F.col("w.start").alias("start"), "key", "value")


def stream_sessions(steps: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """(run, start, end, reward, length) of steps without a longer gap. Also for batches."""
    rows = steps.withWatermark("ts", watermark).groupBy("run", F.session_window("ts", gap).alias("w"))
    out = rows.agg(F.sum("reward").alias("reward"), F.count("*").alias("length"))
    return out.select("run", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "reward", "length")


def stream_labels(replies: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """(pair_id, ts, label) of (pair_id, ts, reply, useful): repeats dropped, replies parsed, pairs that can't be trained on left out."""
    rows = replies.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["pair_id"]) if replies.isStreaming else replies.dropDuplicates(["pair_id"])
    return rows.select("pair_id", "ts", "useful", parse_preference(F.col("reply")).alias("label")).where("useful and label <> -1").drop("useful")


class LabelStore:
    """Labels in a folder that driver and executors share, each batch of a stream exactly once.

    A batch is written into a folder of its own and attempt, and counts when the ledger has a row for it. The ledger is a folder of one small file a batch, whose name is the batch's
    number; the file is put under its name at the end, by one rename, and says which attempt's rows are the batch's. A batch that runs again finds its row there and adds
    nothing; one that died before leaves an attempt that nothing refers to. Numbers are those of one stream and its checkpoint: another stream needs another `stream`.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, stream: str = "labels"):
        self.spark, self.folder, self.schema, self.stream = spark, folder.rstrip("/"), schema, stream

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, self.stream, *parts)))

    def _system(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def ledger(self) -> dict[int, str]:
        """The attempt that counts, by batch."""
        system, at = self._system(), self._path("ledger")
        if not system.exists(at):
            return {}
        names = sorted((f.getPath().getName() for f in system.listStatus(at)), reverse=True)
        return {int(batch): attempt for batch, attempt in (n.split("=") for n in names)}  # of two attempts at once, the lesser name

    def append(self, rows: DataFrame, batch: int, before_commit: Callable[[], None] = lambda: None) -> bool:
        """Add a batch, unless the ledger has it; whether it was added. before_commit runs between the rows and the ledger, for tests."""
        if batch in self.ledger():
            rows.write.format("noop").mode("overwrite").save()  # the states of the stream's operators are of this batch too
            return False
        attempt = uuid.uuid4().hex
        rows.write.parquet(self._path("batches", attempt).toString())
        before_commit()
        system = self._system()
        system.mkdirs(self._path("pending"))
        system.mkdirs(self._path("ledger"))
        waiting = self._path("pending", attempt)
        system.create(waiting).close()
        return bool(system.rename(waiting, self._path("ledger", f"{batch}={attempt}")))

    def sink(self, rows: DataFrame, batch: int) -> None:
        """For writeStream.foreachBatch."""
        self.append(rows, batch)

    def read(self) -> DataFrame:
        paths = [self._path("batches", attempt).toString() for attempt in self.ledger().values()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def clean(self) -> None:
        """Remove attempts that no batch refers to; only while no stream writes."""
        system, known = self._system(), set(self.ledger().values())
        if system.exists(self._path("batches")):
            for found in system.listStatus(self._path("batches")):
                if found.getPath().getName() not in known:
                    system.delete(found.getPath(), True)


def stream_moments(values: DataFrame) -> DataFrame:
    """(key, n, mean, m2) of (key, value) after each batch in update mode; null values don't count. Also for batches.

    Spark's own moments are sums that merge: a task sends one row a key, whatever a key's rows, and the state holds one.
    """
    of = values.groupBy("key").agg(F.count("value").alias("n"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop("value") * F.count("value"), F.lit(0.0)).alias("m2"))
    return of.select("key", "n", "mean", "m2")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What a stream gives for the rows there are now, as an in-memory table; for tests and small catch-ups."""
    stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
