"""Choosing queries: nearest neighbours, ensemble disagreement and entropy, greedy k-center, two-stage selection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmentry.functions.preference import bt_entropy, bt_probability
from segmentry.operators.kernels import block_distances, nearest
from segmentry.operators.trajectory import dense_index
from segmentry.sources.shared import written

#: Vectors of a block of the sample. A block is what each task holds; the blocks are rows dealt to the tasks of the other side.
SAMPLE_BLOCK = 1_024
FULL_BLOCK = 8_192
#: The same where all pairs of blocks are compared, and pairs of blocks at least that there are, of some LEAST_BLOCK vectors of all.
SAMPLE_TILE, FULL_TILE, LEAST_TILES, LEAST_BLOCK = 16_384, 32_768, 16, 1_024
#: An index is used where it leaves at most this share of the pairs, judged by PROBES vectors; else all pairs are compared, by matrix products.
INDEX_SHARE, PROBES = 0.1, 1_024
#: Candidates that k_center brings to the driver in a job.
FRONT = 1_024


#: Pivots of an index at most, unless more are asked for; there are as many as the square root of the vectors. Their vectors, and four numbers a cell, are what tasks are given.
PIVOTS = 256
#: Distances are compared with this relative slack, so that rounding never drops a cell.
SLACK = 1e-9


class Index:
    """Vectors (id, v, pivot, block, away), written, by their nearest pivot; cells of (pivot, block) with their numbers and the least and largest distance from the pivot."""

    def __init__(self, rows: DataFrame, pivots: np.ndarray, cells: pd.DataFrame):
        self.rows, self.pivots, self.cells = rows, pivots, cells.reset_index(drop=True)


def metric_index(vectors: DataFrame, id_col: str = "id", vec_col: str = "vec", pivots: int | None = None, block: int = FULL_BLOCK) -> Index:
    """An index of vectors: each goes to its nearest pivot, a vector drawn by the hash of its id; a pivot of very many is dealt over several cells of some `block` vectors.

    The driver gets the pivots and a row a cell, of which there are no more than pivots and vectors / block together.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    pivots = min(PIVOTS, math.isqrt(rows.count()) + 1) if pivots is None else pivots
    drawn = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()]
    points = np.unique(np.array(drawn, float), axis=0) if drawn else np.zeros((0, 0))
    held = rows.sparkSession.sparkContext.broadcast(points)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = block_distances(np.stack(batch["v"]), held.value)
                best = d.argmin(axis=1)
                yield batch.assign(pivot=best.astype("int32"), away=d[np.arange(len(batch)), best])

    near = written(rows.mapInPandas(work, "id long, v array<double>, pivot int, away double"), "near")
    counts = near.groupBy("pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = near.join(F.broadcast(counts), "pivot").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    dealt = written(dealt, "cells")
    cells = dealt.groupBy("pivot", "block").agg(F.count("*").alias("n"), F.min("away").alias("least"), F.max("away").alias("most")).toPandas()
    return Index(dealt, points, cells)


def _visits(to_pivots: np.ndarray, cells: pd.DataFrame, reach: np.ndarray) -> np.ndarray:
    """(vectors, cells): where a cell may hold something within reach. By the triangle inequality nothing in it is nearer than its ring is."""
    d = to_pivots[:, cells["pivot"].to_numpy()] if len(cells) else np.zeros((len(to_pivots), 0))
    nearest = np.maximum(d - cells["most"].to_numpy(), cells["least"].to_numpy() - d)
    return nearest <= reach[:, None] + SLACK * (1 + d)


def _bounds(to_pivots: np.ndarray, cells: pd.DataFrame, k: int) -> np.ndarray:
    """For each vector a distance within which k of the index lie: whole cells lie within their farthest points."""
    far = to_pivots[:, cells["pivot"].to_numpy()] + cells["most"].to_numpy()
    order = np.argsort(far, axis=1)
    enough = (np.cumsum(cells["n"].to_numpy()[order], axis=1) >= k).argmax(axis=1)
    found = np.take_along_axis(far, np.take_along_axis(order, enough[:, None], axis=1), axis=1)[:, 0]
    return np.where(cells["n"].sum() >= k, found, np.inf)


def _placed(asked: DataFrame, index: Index, k: int, home: bool) -> DataFrame:
    """Rows (id, v, q, cell, reach) of asked (id, v, q, reach): for each cell to be visited one. With home, those of the nearest pivot; else the others within reach."""
    held = asked.sparkSession.sparkContext.broadcast((index.pivots, index.cells))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, cells = held.value
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.iloc[at : at + 1024]
                to_pivots = block_distances(np.stack(batch["v"]), pivots)
                inside = to_pivots.argmin(axis=1)[:, None] == cells["pivot"].to_numpy()
                if not home:
                    reach = np.minimum(batch["reach"].to_numpy(), _bounds(to_pivots, cells, k))
                    inside = _visits(to_pivots, cells, reach) & ~inside
                row, cell = np.nonzero(inside)
                yield batch.iloc[row].assign(cell=cell.astype("int32"))

    return asked.mapInPandas(work, "id long, v array<double>, q int, reach double, cell int")


def _first(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest of each id among rows (id, distance, other)."""
    order = Window.partitionBy("id").orderBy("distance", "other")
    return rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).drop("_place")


def _lists(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("distance", "other"))).alias("near"))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column, which have one length, as rows."""
    whole = pa.concat_arrays(vectors.chunks)
    sizes = whole.value_lengths().to_numpy(zero_copy_only=False)
    if len(set(sizes.tolist())) > 1:
        raise ValueError("vectors of several lengths")
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), sizes[0])


def _tiles(sample: DataFrame, full: DataFrame, k: int, blocks: tuple[int, int] | None, id_col: str, vec_col: str) -> DataFrame:
    """(id, near) as by `_near`, where each block of the sample meets each of all vectors: nothing is left out, and a task holds a block of either. A row of the sample is sent
    once for each block of all vectors, and the other way round."""
    n, m = sample.count(), full.count()
    p, q = -(-n // (blocks or (SAMPLE_TILE, 0))[0]), -(-m // (blocks or (0, FULL_TILE))[1])
    if blocks is None and 0 < p * q < LEAST_TILES:
        q = max(q, min(-(-LEAST_TILES // p), -(-m // LEAST_BLOCK)))
    rows = lambda df, name: df.select(F.col(id_col).cast("long").alias(name), F.col(vec_col).cast("array<double>").alias("v"))
    asked, stored = rows(sample, "id"), rows(full, "other")
    if not m or not n:
        return asked.select("id", F.array().cast("array<struct<distance:double,other:long>>").alias("near"))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda name, count: F.pmod(F.xxhash64(name), F.lit(count)).cast("int")
    left = asked.select(dealt("id", p).alias("p"), every(q).alias("q"), "id", "v").groupBy("p", "q")
    right = stored.select(every(p).alias("p"), dealt("other", q).alias("q"), "other", "v").groupBy("p", "q")
    schema = pa.schema([("id", pa.int64()), ("distance", pa.float64()), ("other", pa.int64())])

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        b = b.sort_by("other")  # ties to the smaller id
        d, few = nearest(_matrix(a["v"]), _matrix(b["v"]), k)
        return pa.table([np.repeat(a["id"].to_numpy(), few.shape[1]), d.ravel(), b["other"].to_numpy()[few].ravel()], schema)

    return _lists(_first(left.cogroup(right).applyInArrow(work, "id long, distance double, other long"), k))


def _indexable(full: DataFrame, k: int, id_col: str, vec_col: str) -> bool:
    """Whether an index would leave few pairs to compare, judged by vectors drawn by the hash of their ids, some of which are the pivots. Fewer vectors have farther neighbours, so
    it errs towards comparing all pairs, which is as right."""
    pivots = min(PIVOTS, math.isqrt(full.count()) + 1)
    drawn = full.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).orderBy(F.xxhash64("id"), "id").limit(pivots + PROBES).collect()
    points = np.array([r["v"] for r in drawn[:pivots]], float)
    probes = np.array([r["v"] for r in drawn[pivots:]], float)
    if len(probes) <= k:
        return False
    to_pivots = block_distances(probes, points)
    own, away = to_pivots.argmin(axis=1), to_pivots.min(axis=1)
    cells = pd.DataFrame({"pivot": own, "away": away}).groupby("pivot")["away"].agg(n="count", least="min", most="max").reset_index()
    reach = nearest(probes, probes, k)[0][:, -1]
    return float((_visits(to_pivots, cells, reach) @ cells["n"].to_numpy()).mean()) <= INDEX_SHARE * len(probes)


def _neighbours(sample: DataFrame, full: DataFrame, k: int, id_col: str, vec_col: str, blocks: tuple[int, int] | None, pivots: int | None) -> DataFrame:
    """(id, near) by an index, if its pivots are asked for or it would leave few pairs, or by all pairs of blocks. Null vectors take no part."""
    sample, full = (x.where(F.col(vec_col).isNotNull()) for x in (sample, full))
    if pivots is None and not _indexable(full, k, id_col, vec_col):
        return _tiles(sample, full, k, blocks, id_col, vec_col)
    size, block = blocks or (SAMPLE_BLOCK, FULL_BLOCK)
    return _near(sample, metric_index(full, id_col, vec_col, pivots, block), k, size, id_col, vec_col)[0]


def _near(sample: DataFrame, index: Index, k: int, size: int, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, near: array of (distance, id) of the k nearest of the index), and the rows (id, cell) that were compared.

    A vector first meets the cells of its nearest pivot. The k-th distance there, or that within which k must lie, is its reach, and only cells whose rings reach into
    it are visited after that. Tasks hold a cell and some `size` vectors.
    """
    n = max(1, -(-sample.count() // size))
    asked = sample.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("q"), F.lit(float("inf")).alias("reach"))
    names = index.rows.sparkSession.createDataFrame([(i, int(c.pivot), int(c.block)) for i, c in enumerate(index.cells.itertuples())], "cell int, pivot int, block int")
    stored = index.rows.join(F.broadcast(names), ["pivot", "block"]).select("cell", "id", "v")

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64"), "other": pd.Series(dtype="int64")})
        b = b.sort_values("other")
        d, few = nearest(np.stack(a["v"]), np.stack(b["w"]), k)  # ties to the smaller id
        return pd.DataFrame({"id": np.repeat(a["id"].to_numpy(), few.shape[1]), "distance": d.ravel(), "other": b["other"].to_numpy()[few].ravel()})

    def met(rows: DataFrame) -> DataFrame:
        wanted = rows.select(F.col("cell").alias("at_cell"), F.col("q").alias("at_q")).distinct()
        held = stored.join(wanted, F.col("cell") == F.col("at_cell")).select(F.col("at_cell").alias("c"), F.col("at_q").alias("r"), F.col("id").alias("other"), F.col("v").alias("w"))
        return rows.groupBy("cell", "q").cogroup(held.groupBy("c", "r")).applyInPandas(work, "id long, distance double, other long")

    if not len(index.cells):
        return asked.select("id", F.array().cast("array<struct<distance:double,other:long>>").alias("near")), asked.select("id", F.lit(0).alias("cell")).limit(0)
    first = written(_placed(asked, index, k, True), "first")
    begun = written(_first(met(first), k), "begun")
    reach = begun.groupBy("id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("reach"))
    more = written(_placed(asked.drop("reach").join(reach, "id").select("id", "v", "q", "reach"), index, k, False), "more")
    return _lists(_first(begun.unionByName(met(more)), k)), first.select("id", "cell").unionByName(more.select("id", "cell"))


def compared_pairs(visits: DataFrame, index: Index) -> int:
    """Pairs of vectors whose distance was taken, of those that there are."""
    sizes = visits.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(index.cells["n"])], "cell int, n long")
    return visits.join(F.broadcast(sizes), "cell").agg(F.sum("n")).first()[0] or 0


def knn_distance(sample: DataFrame, full: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec", blocks: tuple[int, int] | None = None, pivots: int | None = None) -> DataFrame:
    """(id, distance): from each sample vector to the (k+1)-th nearest of all, itself being one of them; null if there are fewer or it is null. Ids are unique."""
    near = _neighbours(sample, full, k + 1, id_col, vec_col, blocks, pivots)
    none = sample.where(F.col(vec_col).isNull()).select(F.col(id_col).cast("long").alias("id"), F.lit(None).cast("double").alias("distance"))
    return near.select("id", F.get("near", F.lit(k))["distance"].alias("distance")).unionByName(none)


def nearest_neighbour(points: DataFrame, targets: DataFrame, id_col: str = "id", vec_col: str = "vec", blocks: tuple[int, int] | None = None, pivots: int | None = None) -> DataFrame:
    """(id, neighbour, distance): the nearest target of each point, ties to the smaller id; points without a target don't come back. Ids are unique."""
    near = _neighbours(points, targets, 1, id_col, vec_col, blocks, pivots)
    return near.where(F.size("near") > 0).select("id", F.get("near", F.lit(0))["other"].alias("neighbour"), F.get("near", F.lit(0))["distance"].alias("distance"))


def entropy_summary(distances: DataFrame, std: float) -> DataFrame:
    """Mean, largest and smallest distance, and the mean in units of a running deviation."""
    return distances.agg(F.avg("distance").alias("mean"), F.max("distance").alias("max"), F.min("distance").alias("min"), F.avg(F.col("distance") / std).alias("mean_scaled"))


def ensemble_stats(preds: DataFrame, value: str, key: str = "pair_id") -> DataFrame:
    """(key, mean, std) over members; std is that of the population."""
    return preds.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def disagreement(preds: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, std): how far the members' probabilities of the preferred segment are apart."""
    stats = ensemble_stats(preds.withColumn("_p", F.round(bt_probability(F.col("r1"), F.col("r2")), 9)), "_p", key)
    return stats.select(key, F.round("std", 6).alias("std"))


def mean_entropy(preds: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, entropy): the mean of the members' entropies."""
    return preds.groupBy(key).agg(F.round(F.avg(F.round(bt_entropy(F.col("r1"), F.col("r2")), 9)), 6).alias("entropy"))


#: Half the width, in shares of all rows, of the border in which the n-th value is looked for.
BORDER = 0.005
#: Rows that a task may hold to find the first among them.
ONE_TASK = 10_000


def top_rows(rows: DataFrame, n: int, value: str, key: str, one_task: int = ONE_TASK) -> DataFrame:
    """The n rows of the largest values, ties to the smaller key; rows without a value are never chosen.

    Up to one_task rows each task keeps its first n, in one pass. For more, of which no task holds n, a quantile sketch gives two values between which the n-th lies, whatever its
    errors. Rows above both are taken, and only those between them are ranked, over range partitions.
    """
    usable = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    if n <= one_task:
        return usable.orderBy(F.desc(value), key).limit(n)
    held = written(usable, "values")
    total = held.count()
    if n >= total:
        return held
    share = 1 - n / total
    low, high = held.approxQuantile(value, [max(0.0, share - 2 * BORDER), min(1.0, share + 2 * BORDER)], BORDER)
    low = float("-inf") if share <= 3 * BORDER else low
    high = float("inf") if share >= 1 - 3 * BORDER else high
    above = held.where(F.col(value) > high)
    wanted = n - above.count()
    border = dense_index(held.where(F.col(value).between(low, high)), [F.desc(value), F.col(key)], "_idx")
    return above.unionByName(border.where(F.col("_idx") < wanted).drop("_idx"))


def disagreement_topk(preds: DataFrame, n: int, key: str = "pair_id") -> DataFrame:
    """The n pairs on whose preferred segment the members' probabilities differ most; ties to the smaller key."""
    return top_rows(disagreement(preds, key), n, "std", key)


def entropy_topk(preds: DataFrame, n: int, key: str = "pair_id") -> DataFrame:
    """The n pairs of the largest mean entropy; ties to the smaller key."""
    return top_rows(mean_entropy(preds, key), n, "entropy", key)


def k_center(candidates: DataFrame, labelled: DataFrame, n: int, id_col: str = "id", vec_col: str = "vec", front: int = FRONT) -> DataFrame:
    """(rank, id, distance) of n candidates, each the one furthest from all labelled and picked so far; ties to the smaller id.

    One pass against the labelled set gives each candidate's distance to it, which picks can only lower: it bounds the distance from above. A job brings the `front`
    candidates of the largest bounds and the one after them. Their distances are kept exact as picks are made among them, and a pick is settled
    as long as it comes before that next one, behind which all others stay. The new picks then lower the other bounds, in one pass, and the next job follows. The driver
    holds front + 1 vectors. With nothing labelled the first pick is the smallest id.
    """
    from segmentry.functions.vectors import distance

    rows = candidates.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    first = nearest_neighbour(candidates, labelled, id_col, vec_col).select("id", F.col("distance").alias("d"))
    state = written(rows.join(first, "id", "left").withColumn("d", F.coalesce("d", F.lit(float("inf")))), "k-center")
    picked: list[tuple] = []
    while len(picked) < n:
        held = state.orderBy(F.desc("d"), "id").limit(front + 1).collect()
        if not held:
            break
        border = (-held[front]["d"], held[front]["id"]) if len(held) > front else (float("inf"), 0)
        held = held[:front]
        ids, d, v = np.array([r["id"] for r in held]), np.array([r["d"] for r in held]), np.array([r["v"] for r in held], float)
        new, left = [], np.ones(len(held), bool)
        while len(picked) < n and left.any():
            at = np.flatnonzero(left & (d == d[left].max()))
            best = int(at[ids[at].argmin()])
            if new and (-d[best], ids[best]) >= border:
                break
            picked.append((len(picked), int(ids[best]), float(d[best])))
            new.append(best)
            left &= ids != ids[best]
            # Sums in the order of the elements, as the columns take them.
            d = np.minimum(d, np.sqrt(np.add.accumulate((v - v[best]) ** 2, axis=1)[:, -1]))
        if len(picked) < n:
            one = candidates.sparkSession.createDataFrame([(ids[new].tolist(), v[new].tolist())], "_ids array<long>, _centres array<array<double>>")
            nearer = F.array_min(F.transform("_centres", lambda c: distance(F.col("v"), c)))
            others = state.crossJoin(F.broadcast(one)).where(~F.array_contains("_ids", F.col("id")))
            state = written(others.select("id", "v", F.least("d", nearer).alias("d")), "k-center")
    return candidates.sparkSession.createDataFrame(picked, "rank int, id long, distance double")


def core_set(candidates: DataFrame, labelled: DataFrame, n: int, parts: int, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """k_center for very many candidates: greedy within parts, then greedy on what they picked. Within twice the greedy radius, not equal to it."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(batches), ignore_index=True).sort_values("id", ignore_index=True)
        if not len(data):
            return
        v, chosen = np.stack(data["v"]), [0]
        d = np.sqrt(((v - v[0]) ** 2).sum(axis=1))
        while len(chosen) < min(n, len(v)):
            chosen.append(int(d.argmax()))
            d = np.minimum(d, np.sqrt(((v - v[chosen[-1]]) ** 2).sum(axis=1)))
        yield data.iloc[chosen]

    rows = candidates.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).repartition(parts, "id")
    few = rows.mapInPandas(work, "id long, v array<double>").withColumnsRenamed({"id": id_col, "v": vec_col})
    return k_center(few, labelled, n, id_col, vec_col)


def two_stage_select(preds: DataFrame, candidates: DataFrame, labelled: DataFrame, n: int, score: str = "disagreement", pool: int | None = None, key: str = "pair_id", vec_col: str = "vec") -> DataFrame:
    """The pool (half of the candidates unless given) by disagreement or entropy, then n of it by k-center. Predictions of others than candidates don't count.

    The pool grows with the candidates; no task holds it.
    """
    pool = candidates.count() // 2 if pool is None else pool
    own = preds.join(candidates.select(key), key, "left_semi")
    by, value = {"disagreement": (disagreement, "std"), "entropy": (mean_entropy, "entropy")}[score]
    top = top_rows(by(own, key), pool, value, key)
    return k_center(candidates.join(top.select(key), key, "left_semi"), labelled, n, key, vec_col)
