"""Hard negatives by a secondary sort.

Vectors become integers, floor(256 * x). Anchors (a stated set of rows) and candidates are cut into blocks of bounded size by hashes, as in `topk`,
and each pair of blocks is one task's group. It is met twice: first for the best rows of each anchor's own label, of which a block can give no more
than `positives`; then, when an anchor's positives are known, for the rows of other labels that may be among the first of a positive's window, of which a
block can give no more than `negatives` a window. What is left goes through one shuffle: each pair's score is packed with its anchor and id
into a key of bytes, whose order is that of (anchor, descending score, positives first, id); repartitionAndSortWithinPartitions deals the keys by anchor and sorts them, and
a task reads them once, in order. A positive opens its window of scores; a negative goes to every open window that its score lies in; a window closes when it is
full or the scores have passed it. A task holds the open windows of one anchor and nothing else, and sorts with what Spark spills.

Rows with a null label or id, a null vector or one with null or non-finite components take no part; missing trailing components count as 0. Of rows that repeat a
vec_id, each counts as a candidate, never for an anchor of its own id, and one is the anchor (the largest by label, then vector). Ties go to the smaller id. A
positive whose score is negative has no window, as the window's upper end lies below its lower one; one with score 0 takes negatives with score 0.
Scores are exact while they fit in 63 bits. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmentry.llm.shared import cut, scratch
from segmentry.llm.topk import CANDIDATES, QUERIES, integers, table_of

#: Anchors of a block whose scores are held at once.
STRIPE = 64
#: anchor, turned score, 0 for a positive or 1 for a negative, id: unsigned, so that the order of the bytes is that of the numbers.
KEY = struct.Struct(">QQBQ")
SIGN = 1 << 63
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def packed(anchor: int, score: int, negative: bool, row_id: int) -> bytes:
    return KEY.pack(anchor + SIGN, SIGN - 1 - score, negative, row_id + SIGN)


def unpacked(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, row_id = KEY.unpack(key)
    return anchor - SIGN, SIGN - 1 - score, bool(negative), row_id - SIGN


def dealt_by_anchor(key: bytes) -> int:
    return zlib.crc32(key[:8])


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score n with low * score <= 100 * n <= high * score; empty (least above greatest) where there is none."""
    return -(-low * score // 100), high * score // 100


def mined(keys: Iterator[bytes], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Rows of RESULT from keys in order. Held: the windows of one anchor that are still open."""
    current, opened, windows = None, 0, []
    for key in keys:
        anchor, score, negative, row_id = unpacked(key)
        if anchor != current:
            current, opened, windows = anchor, 0, []
        if not negative:
            if opened < positives:
                opened += 1
                windows.append([row_id, score, *window_of(score, low, high), 0])
            continue
        still = []
        for w in windows:
            if w[2] <= score <= w[3]:
                w[4] += 1
                yield anchor, w[0], w[4], row_id, w[1], score
            if score >= w[2] and w[4] < negatives:
                still.append(w)
        windows = still


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Those of rows with the k highest scores, ties to the smaller id."""
    if len(rows) > k:
        least = np.partition(scores[rows], len(rows) - k)[len(rows) - k]
        rows = rows[scores[rows] >= least]
    return rows[np.lexsort((ids[rows], -scores[rows]))[:k]]


def _number(*tables: np.ndarray) -> type:
    """Doubles, in which sums of integers are exact below 2**53, or longs where they may be larger."""
    largest = tables[0].shape[1]
    for x in tables:
        largest = float(np.abs(x.astype(np.float64)).max(initial=0)) * largest
    return np.float64 if largest < 2**52 else np.int64


def _scored(anchors: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """(number of an anchor, its scores with all rows), a stripe of anchors at a time."""
    one, two = (table_of(x["v"]) for x in (anchors, rows))
    width = max(one.shape[1], two.shape[1])
    one, two = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (one, two))
    number = _number(one, two)
    one, two = one.astype(number), np.ascontiguousarray(two.astype(number).T)
    for at in range(0, len(one), STRIPE):
        yield from enumerate(one[at : at + STRIPE] @ two, at)


def scored_pairs(rows: DataFrame, is_anchor: Column, positives: int, negatives: int, low: int, high: int, block: int, anchor_block: int) -> DataFrame:
    """(anchor, id, score, negative), written: of rows (id, label, v) each anchor's positives, and of other labels those that a block can have among the first of a window."""
    # Of rows that are equal in all, no more than so many can be in an answer, so that no block is larger than the others for their sake.
    copies = F.explode(F.sequence(F.lit(1), F.least("count", F.lit(max(positives, negatives)))))
    rows = cut(rows.groupBy("id", "label", "v").count().select("id", "label", "v", copies.alias("copy")), "candidates")
    asked = cut(rows.where(is_anchor).groupBy("id").agg(F.max(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v"), "anchors")
    n, m = rows.count(), asked.count()
    c_blocks, a_blocks = max(1, -(-n // block)), max(1, -(-m // anchor_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("id", "label", "v", F.pmod(F.xxhash64("id", "v", "copy"), F.lit(c_blocks)).cast("int").alias("c"), every(a_blocks).alias("a"))
    asked = asked.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(a_blocks)).cast("int"))

    def own(candidates: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        found = []
        for name, part in candidates.groupby("label"):
            some = anchors[anchors["label"] == name]
            if len(some):
                ids, asking = part["id"].to_numpy(), some["id"].to_numpy()
                for i, scores in _scored(some, part):
                    found += [(asking[i], ids[j], scores[j]) for j in best(scores, ids, np.flatnonzero(ids != asking[i]), positives)]
        return pd.DataFrame(found, columns=["anchor", "id", "score"]).astype("int64")

    met = left.groupBy("c", "a").cogroup(asked.withColumn("c", every(c_blocks)).groupBy("c", "a")).applyInPandas(own, "anchor long, id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    firsts = cut(met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).select("anchor", "id", "score"), "positives")
    known = firsts.groupBy(F.col("anchor").alias("id")).agg(F.collect_set("score").alias("scores"))

    def others(candidates: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(candidates) and len(anchors):
            ids, labels = candidates["id"].to_numpy(), candidates["label"].to_numpy()
            for i, scores in _scored(anchors, candidates):
                row = anchors.iloc[i]
                apart = (labels != row["label"]) & (ids != row["id"])
                chosen: set[int] = set()
                for score in row["scores"]:
                    least, most = window_of(int(score), low, high)
                    chosen.update(best(scores, ids, np.flatnonzero(apart & (scores >= least) & (scores <= most)), negatives).tolist())
                found += [(row["id"], ids[j], scores[j]) for j in chosen]
        return pd.DataFrame(found, columns=["anchor", "id", "score"]).astype("int64")

    open_for = asked.join(known, "id").withColumn("c", every(c_blocks))
    apart = left.groupBy("c", "a").cogroup(open_for.groupBy("c", "a")).applyInPandas(others, "anchor long, id long, score long")
    return cut(firsts.withColumn("negative", F.lit(False)).unionByName(apart.withColumn("negative", F.lit(True))), "pairs", keep=True)


def mine_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", vector_col: str = "embedding", block: int = CANDIDATES, anchor_block: int = QUERIES,
) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other labels whose scores are between low and high per cent of the positive's.

    is_anchor is a condition on `id`, label an expression on the columns of vectors. Columns are those of RESULT. block, anchor_block: rows of a block.
    """
    spark = vectors.sparkSession
    value = vectors[vector_col].cast("array<double>")
    usable = value.isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & vectors[id_col].isNotNull() & label.isNotNull()
    rows = vectors.where(usable).select(vectors[id_col].cast("long").alias("id"), label.cast("long").alias("label"), integers(value).alias("v"))
    with scratch(spark):
        pairs = scored_pairs(rows, is_anchor, positives, negatives, low, high, block, anchor_block)
    keyed = pairs.rdd.map(lambda r: (packed(r["anchor"], r["score"], r["negative"], r["id"]), None))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionAndSortWithinPartitions(parts, dealt_by_anchor)
    return spark.createDataFrame(ordered.mapPartitions(lambda keys: mined((k for k, _ in keys), positives, negatives, low, high)), RESULT)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives for each of the five best rows of the label of every fiftieth vector; labels of every seventh are shifted by one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(vectors, F.col("id") % 50 == 0, label)
