"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that is broadcast at most.
BROADCAST_ROWS = 500_000


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in spark.checkpoint.dir, or in local runs, where it may be unset, in a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, counted no further than one more; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """df as Parquet, read again: what is computed from it later doesn't depend on how often it is computed."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
