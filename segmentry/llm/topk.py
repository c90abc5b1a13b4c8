"""Exact top-k inner products by columnar branch and bound.

Vectors become integers, floor(256 * x). Queries (a stated set of rows) and candidates are cut into blocks of bounded
size by hashes of their ids; each pair of blocks is one task's group. There the candidates lie in vertical layout, one array for
each block of dimensions. For each query, scores accumulate a block of dimensions at a time; a candidate survives while its score so far plus
the most that its remaining mass allows (Cauchy-Schwarz on the norms of what is left) reaches the k-th best score known, and
survivors are compacted before the next block. Each group gives k rows a query; those are merged by query.

Vectors that are null or hold null or non-finite components take no part; missing trailing components count as 0.
Rows that repeat a vec_id are candidates each, but never for a query of their own vec_id, and one query each id (that of the
largest vector in order). Rows without vec_id take no part. Scores are exact while they fit in 63 bits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DIMENSIONS = 16
#: Rows of a block: with 64 dimensions 8 MB of candidates, 1 MB of queries.
CANDIDATES, QUERIES = 16_384, 2_048


def vertical(vectors: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Blocks of dimensions, each (dimensions, rows), and the norm of what is left from each block on, a row more than blocks."""
    blocks = [np.ascontiguousarray(vectors[:, a : a + DIMENSIONS].T) for a in range(0, vectors.shape[1], DIMENSIONS)]
    mass = np.array([(b.astype(np.float64) ** 2).sum(axis=0) for b in blocks] + [np.zeros(len(vectors))])
    return blocks, np.sqrt(mass[::-1].cumsum(axis=0)[::-1])


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, id, score) of the k best candidates of each query, ties to the smaller id."""
    width = max(vectors.shape[1], queries.shape[1])
    vectors, queries = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (vectors, queries))
    largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * width
    number = np.float64 if largest < 2**52 else np.int64  # sums of integers in doubles are exact below 2**53
    blocks, mass = vertical(vectors.astype(number))
    rests = vertical(queries.astype(number))[1]
    for row, (query_id, query) in enumerate(zip(query_ids.tolist(), queries.astype(number))):
        alive = np.flatnonzero(ids != query_id)
        score = np.zeros(len(alive), number)
        floor = None
        for j, block in enumerate(blocks):
            part = query[j * DIMENSIONS : (j + 1) * DIMENSIONS]
            score = score + part @ (block if len(alive) == len(ids) else block[:, alive])
            if len(alive) <= k or j + 1 == len(blocks):
                continue
            spread = mass[j + 1][alive] * rests[j + 1][row]
            if floor is None:  # whole scores of the k best so far: the k-th best of all is no less
                first = alive[np.argpartition(score, -k)[-k:]]
                floor = min(sum(query[i * DIMENSIONS : (i + 1) * DIMENSIONS] @ b[:, c] for i, b in enumerate(blocks)) for c in first)
            slack = 1e-9 * (np.abs(score) + spread) + 1
            keep = score + spread + slack >= max(floor, np.partition(score - spread - slack, -k)[-k])
            alive, score = alive[keep], score[keep]
        for i in np.lexsort((ids[alive], -score))[:k].tolist():
            yield query_id, int(ids[alive[i]]), int(score[i])


def integers(column: Column) -> Column:
    return F.transform(column, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = CANDIDATES, query_block: int = QUERIES
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query; is_query is a condition on `id`. block, query_block: rows of a block."""
    value = vectors[vector_col].cast("array<double>")
    usable = value.isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & vectors[id_col].isNotNull()
    rows = vectors.where(usable).select(vectors[id_col].cast("long").alias("id"), integers(value).alias("v"))
    asked = rows.where(is_query).groupBy("id").agg(F.max("v").alias("v"))
    # Of rows that are equal in id and vector no more than k can be among the best, so that no block is larger than the others for their sake.
    rows = rows.groupBy("id", "v").count().select("id", "v", F.explode(F.sequence(F.lit(1), F.least("count", F.lit(k)))).alias("copy"))
    n, m = rows.count(), asked.count()
    c_blocks, q_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))
    dealt = F.pmod(F.xxhash64("id", "v", "copy"), F.lit(c_blocks))
    left = rows.select("id", "v", dealt.cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"))
    right = asked.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("c"))

    def work(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(candidates) and len(queries):
            tables = [table_of(x["v"]) for x in (candidates, queries)]
            found = list(search(candidates["id"].to_numpy(), tables[0], queries["id"].to_numpy(), tables[1], k))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    partial = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(work, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def table_of(column: pd.Series) -> np.ndarray:
    """One array of vectors; shorter ones end in zeros."""
    width = int(column.map(len).max())
    if (column.map(len) == width).all():
        return np.stack(column.to_list()) if width else np.zeros((len(column), 0), np.int64)
    out = np.zeros((len(column), width), np.int64)
    for row, x in zip(out, column):
        row[: len(x)] = x
    return out


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every fiftieth vector, against all rows."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
