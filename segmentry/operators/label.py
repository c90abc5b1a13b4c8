"""Bulk labelling with a pluggable client."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.functions.replies import parse_preference
from segmentry.sources.shared import sized


class Client(Protocol):
    def ask(self, prompt: str, images: list[bytes]) -> str: ...


def with_prompts(pairs: DataFrame, prompts: DataFrame, kind: str, name: str = "prompt") -> DataFrame:
    """pairs with the template of their environment; the table of prompts is a row for each environment and kind, and broadcast if it is small."""
    own = prompts.where(F.col("kind") == kind).select("env", F.col("template").alias(name))
    return pairs.join(sized(own), "env")


class ClientError(Exception):
    """What a client raises where asking again may help; so may any OSError (time-outs and lost connections are such). Other exceptions are faults of the program and end the job."""


class Asker:
    """A client that is asked a few times, and no more often than every `interval` seconds."""

    def __init__(self, client: Client, tries: int, pause: float, interval: float):
        self.client, self.tries, self.pause, self.interval, self.last = client, tries, pause, interval, -math.inf

    def ask(self, prompt: str, images: list[bytes]) -> tuple[str | None, int]:
        """The reply, null if every try failed, and the number of tries."""
        for k in range(1, self.tries + 1):
            time.sleep(max(0.0, self.last + self.interval - time.monotonic()))
            self.last = time.monotonic()
            try:
                return self.client.ask(prompt, images), k
            except (OSError, ClientError):
                if k < self.tries:
                    time.sleep(self.pause)
        return None, self.tries

    def pair(self, query: str, summary: str, images: list[bytes], two_step: bool) -> tuple[str | None, int]:
        reply, tries = self.ask(query, images)
        if two_step and reply is not None:
            reply, more = self.ask(summary.replace("{reply}", reply), [])
            tries += more
        return reply, tries


def label_pairs(pairs: DataFrame, client: Callable[[], Client], concurrency: int, two_step: bool = True, tries: int = 5, pause: float = 3.0) -> DataFrame:
    """pairs (pair_id, query, summary, image_1, image_2) with `reply` (null if every try failed) and `label`.

    As many partitions as may ask at once, one client each. Write the result before using it twice: a recomputed task asks again. `label_with_ledger` doesn't.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asker = Asker(client(), tries, pause, 0.0)
        for batch in batches:
            replies = [asker.pair(q, s, [a, b], two_step)[0] for q, s, a, b in zip(batch["query"], batch["summary"], batch["image_1"], batch["image_2"])]
            yield pd.DataFrame({"pair_id": batch["pair_id"], "reply": replies})

    asked = pairs.select("pair_id", "query", "summary", "image_1", "image_2").repartition(concurrency)
    return asked.mapInPandas(work, "pair_id long, reply string").withColumn("label", parse_preference(F.col("reply")))


LEDGER = "pair_id long, reply string, tries int"


class Ledger:
    """Replies in a folder (a URI) that driver and executors share, a line of JSON each, in files that tasks write as they go.

    A file is the replies of a few pairs, whole when it has its name. It begins with run and partition, so that a task that runs again finds what the attempt before it was told.
    """

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def write(self, run: str, part: int, rows: list[tuple]) -> None:
        system, at = self._system()
        system.create_dir(at, recursive=True)
        name = f"{run}-{part:06d}-{uuid.uuid4().hex}.json"
        with system.open_output_stream(f"{at}/_{name}") as out:  # Spark passes over names that begin with _
            out.write("".join(json.dumps({"pair_id": p, "reply": r, "tries": k}) + "\n" for p, r, k in rows).encode())
        system.move(f"{at}/_{name}", f"{at}/{name}")

    def told(self, run: str, part: int) -> set[int]:
        """The pairs that earlier attempts of this task have asked about."""
        from pyarrow import fs

        system, at = self._system()
        mine = [f.path for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.base_name.startswith(f"{run}-{part:06d}-")]
        return {json.loads(line)["pair_id"] for path in mine for line in system.open_input_file(path).read().decode().splitlines()}

    def read(self, spark: SparkSession) -> DataFrame:
        """(pair_id, reply, tries) of each pair asked about: a reply if there is one, and all tries."""
        from pyarrow import fs

        system, at = self._system()
        if system.get_file_info(at).type == fs.FileType.NotFound:
            return spark.createDataFrame([], LEDGER)
        rows = spark.read.schema(LEDGER).json(self.folder)
        return rows.groupBy("pair_id").agg(F.min("reply").alias("reply"), F.sum("tries").cast("int").alias("tries"))


def label_with_ledger(
    pairs: DataFrame, client: Callable[[], Client], folder: str, concurrency: int, two_step: bool = True, tries: int = 5, pause: float = 3.0, rate: float = math.inf, every: int = 20
) -> DataFrame:
    """As label_pairs, with `tries`, read from a ledger in folder: pairs whose reply is there are not asked about again, whether a task, the job or an earlier call asked.

    Replies are put in the ledger `every` pairs, and at an exception, so no more than what is being asked when an executor is lost is asked twice. Pairs that failed are asked about again
    by the next call. rate is the number of requests a second of all tasks together. pair_id is unique and not null.
    """
    spark, ledger, run = pairs.sparkSession, Ledger(folder), uuid.uuid4().hex
    known = ledger.read(spark).where("reply is not null").select("pair_id")
    wanted = pairs.select("pair_id", "query", "summary", "image_1", "image_2").join(known, "pair_id", "left_anti")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        told = ledger.told(run, part)
        asker, waiting, n = Asker(client(), tries, pause, concurrency / rate), [], 0
        try:
            for batch in batches:
                for pair_id, query, summary, one, two in batch.itertuples(index=False):
                    if pair_id not in told:
                        waiting.append((int(pair_id), *asker.pair(query, summary, [one, two], two_step)))
                        n += 1
                    if len(waiting) >= every:
                        waiting = ledger.write(run, part, waiting) or []
        finally:
            if waiting:
                ledger.write(run, part, waiting)
        yield pd.DataFrame({"n": [n]})

    # Places by a hash of the pair, not dealt in turn, so that a task that runs again has the same pairs.
    asked = wanted.repartition(concurrency, F.xxhash64("pair_id")).mapInPandas(work, "n long")
    asked.agg(F.sum("n")).collect()
    return pairs.select("pair_id").join(ledger.read(spark), "pair_id", "left").select("pair_id", "reply", "tries", parse_preference(F.col("reply")).alias("label"))
