"""What several operators of this folder use: durable cuts of the lineage, and numpy kernels over batches of texts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local runs, where it may be unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Paths of the tables cut inside each open `scratch`, innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def cut(df: DataFrame, what: str = "cut", keep: bool = False) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: later stages start from the files, whichever executor is lost.

    Inside `scratch` the files go at its end, unless they are kept: then at the end of the one around it, if there is one.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    around = _open.get()[:-1] if keep else _open.get()
    if around:
        around[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is cut inside, and not kept, is deleted at the end, on whichever file system the shared folder is."""
    paths: list[str] = []
    token = _open.set((*_open.get(), paths))
    try:
        yield
    finally:
        _open.reset(token)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """df and whether it has at most so many rows, found by counting no further than one more."""
    return df, df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it was counted and is small; otherwise as it is, for a shuffled join."""
    df, few = small(df, rows)
    return F.broadcast(df) if few else df


#: Rows of one key beyond which a join deals them over several tasks, and the keys of that kind that are broadcast at most.
HOT_ROWS, HOT_KEYS = 50_000, 500_000


def spread(rows: DataFrame, table: DataFrame, key: str, n: str = "n", most: int | None = None, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """rows and table, a written table of one row a key whose column n says how many rows have that key, both with `_salt`.

    The rows of a key that has more than `most` are dealt over several salts by a hash of all they hold, and its row of table is repeated
    for each of those; all others have salt 0. Only the names of such keys are broadcast, after they were counted; if they are too many, no key is dealt.
    Nothing is counted where it is known that no key has more than `top` rows and that is few enough.
    """
    most = HOT_ROWS if most is None else most
    if top is not None and top <= most:
        return rows.withColumn("_salt", F.lit(0)), table.withColumn("_salt", F.lit(0))
    hot = table.where(F.col(n) > most).select(key, F.ceil(F.col(n) / most).cast("int").alias("_salts"))
    count = hot.limit(HOT_KEYS + 1).count()
    if not 0 < count <= HOT_KEYS:
        return rows.withColumn("_salt", F.lit(0)), table.withColumn("_salt", F.lit(0))
    salt = F.pmod(F.col("_all"), F.coalesce("_salts", F.lit(1))).cast("int")
    dealt = rows.withColumn("_all", F.xxhash64(*rows.columns)).join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_all", "_salts")
    last = F.when(F.col(n) > most, F.ceil(F.col(n) / most).cast("int") - 1).otherwise(0)
    return dealt, table.withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))


def met_by_key(rows: DataFrame, table: DataFrame, key: str, n: str = "n", most: int | None = None, top: int | None = None) -> DataFrame:
    """rows joined with table on key, keys of very many rows over several tasks (see spread)."""
    left, right = spread(rows, table, key, n, most, top)
    return left.join(right, [key, "_salt"]).drop("_salt")


#: Rows of a batch that goes to Python at most. They hold whole texts, of which Spark's own 10,000 are too many for the memory of an executor.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS; a lower setting stays. It holds for what runs later, as results are lazy."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def in_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(work, schema) in bounded batches; a worker gives its unused memory back before it waits for its next task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()

    bound_batches(df.sparkSession)
    return df.mapInArrow(whole, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_runs(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, end, texts in UTF-8) of runs of rows with about `most` bytes of text at most, one row at least (null: empty)."""
    if len(column):
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        edges = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist(), len(column)]
        for a, b in zip(edges, edges[1:]):
            yield a, b, [x or b"" for x in column.slice(a, b - a).cast(pa.binary()).to_pylist()]


def pieces_of(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows with about `most` bytes of text at most (one row at least), with their texts in UTF-8 (null: empty)."""
    for batch in batches:
        for a, b, texts in text_runs(batch.column(batch.schema.get_field_index(text)), most):
            yield batch.slice(a, b - a), texts


_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(int(_RNG.integers(0, 1 << 62)) * 4 + 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n + 1:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(max(n + 1, 1 << 20), base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans of one buffer; equal bytes hash alike wherever they stand. For sieves and features: as sums of powers they can be made to collide."""
    forth, back = _power_tables(len(buffer))
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE[buffer] * forth[: len(buffer)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * back[starts] ^ (ends - starts).astype(np.uint64))


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) words of texts, one blank between: buffer, starts, ends and words of each text."""
    words = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    buffer = np.frombuffer(b" ".join(b" ".join(w) for w in words if w), np.uint8)
    if not len(buffer):
        return buffer, np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    blanks = np.flatnonzero(buffer == 32)
    return buffer, np.concatenate(([0], blanks + 1)), np.concatenate((blanks, [len(buffer)])), counts


def shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; a text of fewer words is one shingle, one without words has none.

    Words are hashed one by one (XXH3), and a shingle by its number of words and their hashes in turn, each scrambled before the next: no sum of powers, whose
    collisions are known in advance.
    """
    import xxhash

    words = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    out, at = [], 0
    step = np.uint64(0x9E3779B97F4A7C15)
    for n in counts.tolist():
        own, size = hashed[at : at + n], min(n, width)
        at += n
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        whole = np.full(n - size + 1, size, np.uint64)
        for i in range(size):
            whole = mix64(whole * step + own[i : i + len(whole)])
        out.append(np.unique(whole))
    return out


def filtered(docs: DataFrame, decide: Callable[[list[bytes]], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose texts `decide` keeps; it gets runs of texts in UTF-8, and only texts go to Python."""

    @F.arrow_udf("boolean")
    def keeps(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            kept = [np.asarray(decide(raw), bool) for _, _, raw in text_runs(texts)]
            yield pa.array(np.concatenate(kept) if kept else np.zeros(0, bool))
        pa.default_memory_pool().release_unused()

    bound_batches(docs.sparkSession)
    return docs.where(keeps(docs[text_col].cast("string")))
