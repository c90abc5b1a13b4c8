"""Packing of token pieces into sequences: Martello-Toth dominance reduction, then best fit, both on the histogram of lengths.

Which sequence a piece goes to depends on its length alone, so the plan is made from counts of pieces by length: at
most `capacity` numbers, whatever the corpus holds. A plan is a list of (pattern of lengths, number of sequences).
Spark counts the lengths, ranks the pieces of each length, and looks up each rank's place in the plan.

Reduction (Martello and Toth, 1990): a set of pieces that holds the largest piece and dominates every other set that could
share a sequence with it is fixed for good. Fixed here: the piece alone if nothing fits beside it; the piece with the
largest piece a that fits if together they fill the sequence, if no two pieces fit beside it, or if no three do and no two
that do hold more than a; and, where no three fit beside it, the piece with a and b, the two that fill the most, if no two pieces
larger than b fit beside it but with a. What is left is packed by best fit, longest pieces first.

Null and empty texts have the end id alone. Rows that repeat a document are packed each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmentry.llm.shared import cut, in_arrow, pieces_of
from segmentry.llm.wordbpe import encoder

Plan = list[tuple[tuple[int, ...], int]]


def reduce_instance(counts: np.ndarray, capacity: int) -> Plan:
    """Fix dominating sets, taking their pieces from counts (number of pieces by length)."""
    plan: Plan = []
    for length in range(capacity, 0, -1):
        while counts[length]:
            left = counts.copy()
            left[length] -= 1
            fixed = dominating(left, length, capacity)
            if not fixed:
                break
            # The set dominates as long as all its pieces are there: what goes only takes other sets away.
            times = min(int(counts[x]) // fixed.count(x) for x in fixed)
            for x in fixed:
                counts[x] -= times
            plan.append((fixed, times))
    return plan


def dominating(left: np.ndarray, length: int, capacity: int) -> tuple[int, ...] | None:
    """The set of up to three lengths that dominates all others with a piece of this length, the largest; left: the other pieces."""
    room = capacity - length
    fits = np.flatnonzero(left[: room + 1])
    if not len(fits):
        return (length,)
    a = int(fits[-1])
    smallest = np.repeat(fits[:3], np.minimum(left[fits[:3]], 3))[:3]
    if a == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return (length, a)
    if len(smallest) == 3 and smallest.sum() <= room:
        return None
    partner = np.searchsorted(fits, room - fits, side="right") - 1
    own = (partner >= 0) & (fits[partner] == fits) & (left[fits] < 2)  # a single piece is no pair with itself
    partner = np.where(own, partner - 1, partner)
    sums = np.where(partner >= 0, fits + fits[np.maximum(partner, 0)], 0)
    most = int(sums.max())
    if most <= a:
        return (length, a)
    b = most - a
    if b > a or sums[-1] != most:
        return None  # the fullest pair is without the largest piece that fits
    between = fits[fits > b]
    rest = np.minimum(left[between], 2)
    rest[-1:] -= len(rest) > 0  # a itself
    two = np.repeat(between, rest)[:2]
    return (length, a, b) if len(two) < 2 or two.sum() > room else None


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best fit decreasing; sequences that hold the same lengths are one group."""
    open_: dict[int, list[list]] = {}
    room = np.zeros(capacity + 1, bool)

    def put(pattern: tuple[int, ...], rest: int, times: int) -> None:
        if times:
            open_.setdefault(rest, []).append([pattern, times])
            room[rest] = True

    for length in range(capacity, 0, -1):
        n = int(counts[length])
        while n:
            where = np.flatnonzero(room[length:])
            if len(where):
                rest = length + int(where[0])
                group = open_[rest][-1]
            else:
                rest, group = capacity, [(), n]
            each = rest // length
            whole = min(group[1], n // each)
            part = n % each if whole < group[1] and n // each == whole else 0
            put(group[0] + (length,) * each, rest - each * length, whole)
            put(group[0] + (length,) * part, rest - part * length, int(part > 0))
            if len(where):
                group[1] -= whole + (part > 0)
                if not group[1]:
                    open_[rest].pop()
                    room[rest] = bool(open_[rest])
            n -= whole * each + part
    return [(pattern, times) for groups in open_.values() for pattern, times in groups]


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    fixed = reduce_instance(counts, capacity)
    return fixed + best_fit(counts, capacity)


def slots(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence and offset of each run of places, in order of rank."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    first: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            at = first.get(length, 0)
            runs.setdefault(length, []).append((at, sequence, offset))
            first[length] = at + times
            offset += length
        sequence += times
    return {length: tuple(np.array(c, np.int64) for c in zip(*rows)) for length, rows in runs.items()}


def token_pieces(docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document: its ids and the end id, cut at capacity; ids little-endian unsigned 32-bit."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kinds = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for part, texts in pieces_of(batches):
            out = []
            for doc_id, text in zip(part.column(0).to_pylist(), texts):
                raw = enc.encode(text).tobytes() + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    ids = raw[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(ids) // 4, ids))
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), kinds)], schema=kinds)

    return in_arrow(rows, work, "doc_id long, piece int, start long, length long, ids binary")


def assign(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (doc_id, piece, start, length and more, length from 1 to capacity) with sequence_id and offset; they are written once, with the columns that they have."""
    spark = pieces.sparkSession
    pieces = cut(pieces, "pieces")
    histogram = dict(tuple(r) for r in pieces.groupBy("length").count().collect())  # at most `capacity` rows
    places = slots(make_plan(histogram, capacity))
    # The pieces of one length may be a third of all: each length is dealt out by a hash of its pieces, and ranks start where the shares before end.
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ranks go by all that a piece holds, so that a task that runs again ranks alike; pieces that are equal in all may change places.
    order = ["doc_id", "piece", "start", *(c for c in pieces.columns if c not in ("doc_id", "piece", "start", "length"))]
    dealt = pieces.withColumn("_share", F.pmod(F.xxhash64(*order), F.lit(shares)))
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("length", "_share").count().withColumn("_first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("length", "_share").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(within)).join(firsts, ["length", "_share"])
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1 + F.col("_first")).select(*pieces.columns, "_rank")
    place = ranked.schema.fieldNames().index("_rank"), ranked.schema.fieldNames().index("length")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = (batch.column(i).to_numpy() for i in place)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for run in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(run):
                    first, base, at = places[int(length[run[0]])]
                    k = np.searchsorted(first, rank[run], side="right") - 1
                    sequence[run], offset[run] = base[k] + rank[run] - first[k], at[k]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return in_arrow(ranked, work, f"{schema}, sequence_id long, offset long")


def sequences(assigned: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths): the packed sequences themselves, of assigned pieces with their ids."""
    parts = assigned.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    return parts.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.col("p.length").alias("lengths"))


def pack_documents(docs: DataFrame, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs."""
    pieces = token_pieces(docs, capacity)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return assign(digests, capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4096)
