"""How good the labels are: accuracy by round and by difficulty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_accuracy(pairs: DataFrame) -> DataFrame:
    """(train_iter, n, accuracy) by round and overall (train_iter null): the share of kept labels that are rational; 0 where none is kept."""
    kept = (F.col("label") != -1) & F.col("useful")
    right = F.avg(F.when(kept, (F.col("label") == F.col("rational_label")).cast("double")))
    return pairs.rollup("train_iter").agg(F.count(F.when(kept, 1)).alias("n"), F.coalesce(right, F.lit(0.0)).alias("accuracy"))


def assign_bins(log: DataFrame, bins: int, s1: str = "score_1", s2: str = "score_2") -> DataFrame:
    """log with `bin`: the difference of the scores among `bins` equal bins up to the largest difference; the last is closed.

    A difference belongs to the last edge at or below it, edges being whole multiples of one rounded step. The largest difference (1 if all are 0)
    is one row, broadcast. Differences that are no finite number are dropped.
    """
    diff = F.abs(F.col(s1) - F.col(s2))
    rows = log.withColumn("_diff", diff).where(~F.isnan("_diff") & (F.col("_diff") < float("inf")))
    top = rows.agg(F.when(F.max("_diff") > 0, F.max("_diff")).otherwise(1.0).alias("_top"))
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.when(i == bins, F.col("_top")).otherwise(i * (F.col("_top") / bins)))
    placed = rows.join(F.broadcast(top.select("_top", edges.alias("_edges")))).withColumn("bin", F.least(F.size(F.filter("_edges", lambda e: e <= F.col("_diff"))), F.lit(bins)) - 1)
    return placed.withColumn("centre", (F.get("_edges", F.col("bin")) + F.get("_edges", F.col("bin") + 1)) / 2).drop("_diff", "_top", "_edges")


def category(label: Column, s1: Column, s2: Column) -> Column:
    """no_preference for -1; equal scores with a preference are incorrect."""
    return F.when(label == -1, "no_preference").when(((label == 0) & (s1 > s2)) | ((label == 1) & (s2 > s1)), "correct").otherwise("incorrect")


CATEGORIES = ("correct", "incorrect", "no_preference")


def difficulty_histogram(log: DataFrame, bins: int, label: str = "label", s1: str = "score_1", s2: str = "score_2") -> DataFrame:
    """(bin, n, and the percentage of each category) for every bin, empty ones at 0. At most bins x 3 groups are shuffled."""
    placed = assign_bins(log, bins, s1, s2).withColumn("category", category(F.col(label), F.col(s1), F.col(s2)))
    counts = placed.groupBy("bin").pivot("category", list(CATEGORIES)).agg(F.count(F.lit(1)))
    every = log.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    n = sum((F.coalesce(c, F.lit(0)) for c in CATEGORIES), F.lit(0))
    share = lambda c: F.coalesce(F.try_divide(100.0 * F.coalesce(c, F.lit(0)), n), F.lit(0.0)).alias(c)
    return every.join(F.broadcast(counts), "bin", "left").select("bin", n.cast("long").alias("n"), *map(share, CATEGORIES))
