"""Query logs, evaluation logs, label batches, frames and checkpoints."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmentry.sources.schemas import QUERY_LOG, require
from segmentry.sources.shared import sized, written

# Columns of the log files.
QUERY_COLUMNS = ["ground_truth_score_1", "ground_truth_score_2", "vlm_predicted_label", "timestamp", "train_iter"]


def _number(name: str) -> Column:
    value = F.col(name).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def clean_query_log(raw: DataFrame) -> DataFrame:
    """Typed rows of a log of strings; rows whose scores or label are no finite numbers are skipped. A label may read 1.0."""
    rows = require(raw, QUERY_COLUMNS[:3]).select(
        _number("ground_truth_score_1").alias("ground_truth_score_1"),
        _number("ground_truth_score_2").alias("ground_truth_score_2"),
        _number("vlm_predicted_label").cast("int").alias("vlm_predicted_label"),
        *([_number("timestamp").alias("timestamp")] if "timestamp" in raw.columns else []),
        *([_number("train_iter").cast("int").alias("train_iter")] if "train_iter" in raw.columns else []),
    )
    return rows.na.drop(subset=QUERY_COLUMNS[:3])


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    """A log in CSV with a header. A log without a good row is an error."""
    rows = clean_query_log(spark.read.option("header", True).csv(path))
    if rows.isEmpty():
        raise ValueError(f"no usable row in {path}")
    return rows


def write_query_log(rows: DataFrame, path: str, csv: bool = False) -> None:
    """Append a batch; the header of CSV files is each file's own."""
    out = require(rows, QUERY_COLUMNS).selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in QUERY_LOG.split(", "))).write.mode("append")
    out.option("header", True).csv(path) if csv else out.parquet(path)


def clean_eval_log(raw: DataFrame) -> DataFrame:
    """(step, success_rate) with rates above 1 read as per cent, clipped to [0, 1]; bad rows are skipped."""
    rows = require(raw, ["step", "success_rate"]).select(_number("step").alias("step"), _number("success_rate").alias("r")).na.drop()
    rate = F.when(F.col("r") > 1, F.col("r") / 100).otherwise(F.col("r"))
    return rows.select("step", F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate)).alias("success_rate"))


def read_eval_log(spark: SparkSession, path: str) -> DataFrame:
    return clean_eval_log(spark.read.option("header", True).csv(path))


def write_label_batches(pairs: DataFrame, path: str) -> None:
    """One directory for each environment and round."""
    require(pairs, ["env", "train_iter"]).write.mode("append").partitionBy("env", "train_iter").parquet(path)


def numbered_rounds(pairs: DataFrame) -> DataFrame:
    """pairs with `round` (from 1): the place of their train_iter among those of their environment. The list of rounds, a row a round, is broadcast if it is small."""
    rounds = pairs.select("env", "train_iter").distinct()
    order = Window.partitionBy("env").orderBy("train_iter")
    return pairs.join(sized(rounds.withColumn("round", F.row_number().over(order))), ["env", "train_iter"])


def read_label_batches(spark: SparkSession, path: str) -> DataFrame:
    return numbered_rounds(spark.read.parquet(path))


def stream_label_batches(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Label batches as a stream, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def frame_keys(path: Column) -> list[Column]:
    """Keys in a frame's file name: side and number of a pair's frame, or step, episode and success of a run's."""
    part = lambda pattern: F.regexp_extract(path, pattern, 1)
    number = lambda pattern: F.when(part(pattern) != "", part(pattern)).try_cast("int")
    side = part(r"(first|second)_\d{6}\.png$")
    return [
        F.when(side != "", side).alias("side"),
        number(r"(?:first|second)_(\d{6})\.png$").alias("number"),
        number(r"step(\d{7})_episode\d{2}_\d+\.png$").alias("step"),
        number(r"step\d{7}_episode(\d{2})_\d+\.png$").alias("episode"),
        number(r"step\d{7}_episode\d{2}_(\d+)\.png$").alias("success"),
    ]


def png(height: int, width: int, channels: int, data: bytes) -> bytes:
    """A PNG file of 8-bit grey or red-green-blue pixels."""
    rows = b"".join(b"\0" + data[i * width * channels : (i + 1) * width * channels] for i in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def write_frames(frames: DataFrame, folder: str) -> DataFrame:
    """Write frames (name, frame) as PNG files in folder (a URI); (file) of each. A task that runs again writes the same files."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = fs.FileSystem.from_uri(folder)
        system.create_dir(at, recursive=True)
        for batch in batches:
            for name, frame in zip(batch["name"], batch["frame"]):
                with system.open_output_stream(f"{at}/{name}", compression=None) as out:
                    out.write(png(frame["h"], frame["w"], frame["c"], bytes(frame["data"])))
            yield pd.DataFrame({"file": batch["name"]})

    return written(frames.select("name", "frame").mapInPandas(work, "file string"), "frames")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, keys, frame) of decoded image files. Channels are blue, green, red, as Spark's image source has them; reverse_channels turns them."""
    images = spark.read.format("image").option("recursiveFileLookup", True).load(path)
    frame = F.struct(F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("c"), F.col("image.data").alias("data"))
    return images.select(F.col("image.origin").alias("path"), *frame_keys(F.col("image.origin")), frame.alias("frame"))


CHECKPOINT = r"(actor|critic_target|critic|reward_model)_(\d+)(?:_(\d+))?\.pt$"


def latest_checkpoint(files: DataFrame, path: str = "path") -> DataFrame:
    """(kind, member, step, path) of the newest file of each kind and member (-1: none); other files are skipped."""
    kind, step, member = (F.regexp_extract(path, CHECKPOINT, i) for i in (1, 2, 3))
    rows = files.select(kind.alias("kind"), F.coalesce(F.when(member != "", member).try_cast("int"), F.lit(-1)).alias("member"), F.when(step != "", step).try_cast("long").alias("step"), F.col(path).alias("path")).where("kind <> ''")
    return rows.groupBy("kind", "member").agg(F.max(F.struct("step", "path")).alias("m")).select("kind", "member", "m.step", "m.path")
