"""Near duplicates of embeddings by Euclidean p-stable hashing.

Vectors are normalised, so that a cosine of c is a distance of sqrt(2 - 2c). Each of TABLES tables cuts PROJECTIONS random Gaussian projections into
cells of WIDTH; vectors of one label that lie in the same cells of a table share a bucket. Every pair of a bucket is then held to the exact cosine in doubles.

Rows whose labels and vectors are equal are one class, so that copies are never compared. Buckets are counted first, by their keys alone, and only members of buckets of two
classes or more bring their vectors. A large bucket is dealt in blocks, and each pair of blocks is compared inside a task as two arrays. A pair that shares several buckets
counts in the first of their tables alone, which a task knows from the keys that each vector carries. No pair leaves a task: a task gives the number of links that each
vector has in a block, and links that connect the block as all its links do.

A pair at the threshold of 0.93 is missed with probability `missed(0.93)`, 1.1e-5, one of 0.95 with 1e-8. A group of g vectors that are all alike costs g^2 comparisons, which
exact numbers of links ask for; rows that leave tasks grow with g and with its blocks.

Rows with a null id, label or vector, and vectors that are empty, zero or hold null or non-finite components, have no links and are kept. Missing trailing components count
as 0. Rows that repeat a vec_id give a row each, and link like any other rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.llm.minhash import components
from segmentry.llm.shared import cut, in_arrow, met_by_key, mix64, scratch

TABLES, PROJECTIONS, WIDTH = 160, 12, 1.5
#: Vectors on a side of a block.
BLOCK = 1024
#: Vectors of a bucket up to which its pairs are listed together with those of other buckets.
FEW = 32
SEED = 9173


def missed(cosine: float, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> float:
    """Probability that no table brings a pair of this cosine together."""
    r = width / math.sqrt(2 - 2 * cosine)
    same = math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))
    return (1 - same**projections) ** tables


def normalised(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled by their largest component first, so that no square overflows or vanishes."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def projections_of(width: int, tables: int, projections: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian rows, one for each dimension whatever the number of dimensions, and the offsets of the cells in units of their width."""
    rows = [np.random.default_rng((SEED, i)).normal(size=tables * projections) for i in range(width)]
    return np.array(rows).reshape(width, tables * projections), np.random.default_rng(SEED).random(tables * projections)


def table_keys(unit: np.ndarray, tables: int, projections: int) -> np.ndarray:
    """A 32-bit number for the cells of each vector in each table."""
    gauss, offset = projections_of(unit.shape[1], tables, projections)
    cells = np.floor(unit @ gauss / WIDTH + offset).astype(np.int64).view(np.uint64).reshape(len(unit), tables, projections)
    key = np.zeros(cells.shape[:2], np.uint64)
    for i in range(projections):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, i])
    return (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _named(rows: DataFrame) -> DataFrame:
    """(id, label, sid, unit) of rows (id, label, v): sid names label and vector, unit is the normalised vector without trailing zeros, as bytes; both null where a row has no links."""

    def unit_of(values: list | None) -> np.ndarray | None:
        if values is None or None in values:
            return None
        x = np.trim_zeros(np.array(values, float), "b")
        return normalised(x[None])[0] if len(x) and np.isfinite(x).all() else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, lists = (batch.column(i).to_pylist() for i in range(3))
            units = [None if i is None or k is None else unit_of(x) for i, k, x in zip(ids, labels, lists)]
            names = [None if u is None else hashlib.blake2b(k.encode() + b"\0" + np.array(x, float).tobytes(), digest_size=16).digest() for u, k, x in zip(units, labels, lists)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array([None if u is None else u.tobytes() for u in units], pa.binary())], names=["id", "label", "sid", "unit"])

    return in_arrow(rows, work, "id long, label string, sid binary, unit binary")


def _keyed(classes: DataFrame, tables: int, projections: int) -> DataFrame:
    """classes (sid, id, label, copies, unit) with `keys`, the numbers of each table's cells as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys = table_keys(units_of(part.column(4)), tables, projections)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([k.tobytes() for k in keys], pa.binary())], names=[*part.schema.names, "keys"])

    return in_arrow(classes, work, "sid binary, id long, label string, copies long, unit binary, keys binary")


def units_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One array of vectors; shorter ones end in zeros."""
    units = [np.frombuffer(x, float) for x in column.to_pylist()]
    out = np.zeros((len(units), max(map(len, units), default=0)))
    for row, x in zip(out, units):
        row[: len(x)] = x
    return out


def _buckets(classes: DataFrame) -> DataFrame:
    """(no, bucket) for every table: the bucket's name is that of table, label and cells."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                label = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in batch.column(1).to_pylist()], np.uint64)
                keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
                names = mix64(mix64(label)[:, None] ^ (np.arange(keys.shape[1], dtype=np.uint64) << np.uint64(32) | keys.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1])), pa.array(np.tile(np.arange(keys.shape[1], dtype=np.int32), batch.num_rows)), pa.array(names.view(np.int64).ravel())], names=["no", "t", "bucket"])

    return in_arrow(classes.select("no", "label", "keys"), work, "no long, t int, bucket long")


class Members:
    """Rows of one batch of sorted members, as arrays."""

    def __init__(self, table: pa.Table):
        self.no, self.copies, self.left = (table.column(c).to_numpy() for c in ("no", "copies", "is_left"))
        self.label = np.array(table.column("label").to_pylist(), object)
        self.unit = units_of(table.column("unit"))
        self.keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int32).reshape(len(self.no), -1)
        self.t = table.column("t").to_numpy()
        names = [table.column(c).to_numpy() for c in ("bucket", "i", "j")]
        starts = np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in names], axis=0))))
        self.ends = np.concatenate((starts[1:], [len(self.no)]))
        self.starts = starts
        self.diagonal = names[1] == names[2]

    def first_here(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of one table share that table's cells, the label, and no cells of an earlier table."""
        t = self.t[a]
        new = (self.keys[a, t] == self.keys[b, t]) & (self.label[a] == self.label[b])
        for earlier in range(int(t.max(initial=0))):
            at = np.flatnonzero(new & (t > earlier))
            if len(at):
                new[at] = self.keys[a[at], earlier] != self.keys[b[at], earlier]
        return new

    def small_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of the buckets of a few vectors."""
        size = np.repeat(self.ends - self.starts, self.ends - self.starts)
        end, place = np.repeat(self.ends, self.ends - self.starts), np.arange(len(self.no))
        few = place[(size <= FEW) & self.diagonal]
        firsts, seconds = [], []
        for step in range(1, FEW):
            a = few[few + step < end[few]]
            if not len(a):
                break
            firsts.append(a)
            seconds.append(a + step)
        none = np.zeros(0, np.int64)
        return (np.concatenate(firsts), np.concatenate(seconds)) if firsts else (none, none)

    def large(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The two sides of every other block; they are the same one where a block meets itself."""
        for a, b in zip(self.starts.tolist(), self.ends.tolist()):
            rows = np.arange(a, b)
            if not self.diagonal[a]:
                yield rows[self.left[a:b]], rows[~self.left[a:b]]
            elif b - a > FEW:
                yield rows, rows


def _links_of(block: Members, a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of two sides of one bucket, each in its first table."""
    linked = block.unit[a] @ block.unit[b].T >= cosine
    if a is b:
        linked = np.triu(linked, 1)
    i, j = np.nonzero(linked)
    new = block.first_here(a[i], b[j])
    return a[i[new]], b[j[new]]


def connecting_links(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of links (a, b) those that connect what all of them connect."""
    group: dict[int, int] = {}

    def top(x: int) -> int:
        while group.setdefault(x, x) != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            group[p] = q
            out.append((x, y))
    return out


def compared(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """(a, b, n) of members sorted by bucket and block: links (a, b) that connect, with n null, and the numbers n of links of a, with b null."""

    def results(table: pa.Table) -> pa.RecordBatch:
        block = Members(table)
        n = np.zeros(len(block.no), np.int64)
        edges = []

        def take(a: np.ndarray, b: np.ndarray) -> None:
            np.add.at(n, a, block.copies[b])
            np.add.at(n, b, block.copies[a])
            edges.extend(connecting_links(block.no[a], block.no[b]))

        a, b = block.small_pairs()
        if len(a):
            new = block.first_here(a, b)
            a, b = a[new], b[new]
            near = np.concatenate([np.einsum("ij,ij->i", block.unit[a[k : k + 4096]], block.unit[b[k : k + 4096]]) for k in range(0, len(a), 4096)] or [np.zeros(0)]) >= cosine
            take(a[near], b[near])
        for left, right in block.large():
            if len(left) and len(right):
                take(*_links_of(block, left, right, cosine))
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(([x for x, _ in edges], block.no[some])).astype(np.int64)),
                pa.array([y for _, y in edges] + [None] * len(some), pa.int64()),
                pa.array([None] * len(edges) + n[some].tolist(), pa.int64()),
            ],
            names=["a", "b", "n"],
        )

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        held = pa.concat_tables([held, table]) if held is not None and held.num_rows else table
        names = [held.column(c).to_numpy() for c in ("bucket", "i", "j")]
        last = np.flatnonzero(np.any([x != x[-1] for x in names], axis=0))
        whole = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
        if whole:
            yield results(held.slice(0, whole))
            held = held.slice(whole)
    if held is not None and held.num_rows:
        yield results(held)


def near_vectors(
    vectors: DataFrame, percent: int = 93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tables: int = TABLES, projections: int = PROJECTIONS, block: int = BLOCK
) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row: links join rows of one label whose cosine is percent / 100 or more."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast("array<double>").alias("v"))
    with scratch(vectors.sparkSession):
        named = cut(_named(rows), "named")
        own = [F.first(c).alias(c) for c in ("label", "unit")]  # the same in all rows of a class
        classes = named.where("sid is not null").groupBy("sid").agg(F.min("id").alias("id"), F.count("*").alias("copies"), *own)
        classes = cut(_keyed(classes.select("sid", "id", "label", "copies", "unit"), tables, projections).withColumn("no", F.monotonically_increasing_id()), "classes")
        found = cut(_compared(classes, percent / 100, block), "found")
        more = found.where("b is null").groupBy(F.col("a").alias("no")).agg(F.sum("n").alias("more"))
        joined = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "no")
        told = classes.select("sid", "no", "id", "copies").join(more, "no", "left").join(joined, "no", "left")
        told = cut(told.select("sid", "id", "copies", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "no").alias("root")), "told")
        least = cut(told.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("n")), "least")
        labels = cut(met_by_key(told.select("sid", "copies", "n_links", "root"), least, "root").select("sid", "copies", "n_links", "component_id"), "labels", keep=True)
        ids = cut(named.select("id", "sid"), "ids", keep=True)
    out = met_by_key(ids.where("sid is not null"), labels, "sid", "copies").select("id", "n_links", "component_id")
    out = out.unionByName(ids.where("sid is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def _compared(classes: DataFrame, cosine: float, block: int) -> DataFrame:
    """(a, b, n) of `compared` over all buckets of two classes or more; those of very many in pairs of blocks."""
    keys = _buckets(classes)
    shared = cut(keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    top = shared.agg(F.max("n")).first()[0] or 0
    n_blocks = F.ceil(F.col("n") / block)
    members = met_by_key(keys, shared, "bucket", top=top).withColumn("own", F.pmod(F.xxhash64("bucket", "no"), n_blocks))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
    placed = members.select("no", "t", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("is_left"))
    rows = placed.join(classes.select("no", "label", "copies", "unit", "keys"), "no").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return in_arrow(rows, lambda batches: compared(batches, cosine), "a long, b long, n long")


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between vectors of one label whose cosine is 0.93 or more."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
