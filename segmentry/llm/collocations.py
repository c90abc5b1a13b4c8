"""Phrase collocations from sorted count streams.

Texts are lower-cased (A-Z) and cut at . , ; : ! ? and line ends into pieces, those at blanks and tabs into words. Tasks count the words and
phrases of runs of text, Spark adds the counts. Phrases of three words are counted in a second reading, and only where both phrases of two words in them may be frequent
enough, as a filter of fixed size says: it lets some through that are not, and holds none back that is, so that counts are exact whatever its size.

The counts that are high enough form one stream, in the order of their words (prefix order): each phrase comes after the words and phrases that it begins with, so that one reading
hands it their counts (left). The same stream is then put in the order of the words from the last to the first (suffix order), where one reading hands each phrase the
counts of those that it ends with (right), and a phrase of three words knows whether it makes up half of the phrase of two that it begins or ends with (extension). Neither reading looks anything
up by a hash. Streams are written in range partitions, which cut through the run of a frequent word like any other; what a partition begins with is carried over from those before
it, in a row a partition.

A null text is empty, a null language `und`. Rows that repeat, and rows with a null id, count like any other; other columns are ignored. A text of any length is read in runs of bounded
size, and a run that is cut inside a piece starts with the two words before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmentry.llm.shared import cut, hinted, in_arrow, mix64, scratch, span_hashes

#: Bytes of text whose phrases are counted together.
RUN = 6 << 20
#: Bits of the filter for phrases of three words, a power of 2, and bits set for each phrase of two.
FILTER_BITS, FILTER_HASHES = 1 << 26, 2
#: Bits of one of Spark's bitmaps.
BITMAP = 32_768
#: Languages that are broadcast at most.
BROADCAST_ROWS = 500_000
_CLEAN = bytes.maketrans(b"\t.,;:!?\x0b\x0c\r", b" " + b"\n" * 9)
_GAP = re.compile(rb"[ \n]")


def runs(text: bytes, most: int) -> Iterator[tuple[list[bytes], bytes]]:
    """(words before, part) of a cleaned text, cut at blanks and line ends; the words before are the two at most that stand in the same piece."""
    at, before = 0, []
    while len(text) - at > most:
        gap = _GAP.search(text, at + most)
        if not gap:
            break
        part = text[at : gap.start()]
        yield before, part
        _, line, tail = part.rpartition(b"\n")
        before = ([] if line else before) + tail.split()[-2:]
        at, before = gap.start(), before[-2:]
    yield before, text[at:]


class Counts:
    """Words and phrases of one run of cleaned text; those that end in its first words are not counted."""

    def __init__(self, text: bytes, before: list[bytes] = []):  # noqa: B006
        text = b" ".join([*before, text])
        letters = np.frombuffer(text, np.uint8)
        inside = (letters != 32) & (letters != 10)
        starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
        self.piece = np.cumsum(letters == 10, dtype=np.int32)[starts]
        coded = pa.array(text.split(), pa.binary()).dictionary_encode()
        self.words, self.code, self.skip = coded.dictionary, coded.indices.to_numpy().astype(np.int64), len(before)
        self.joined = self.piece[1:] == self.piece[:-1] if len(starts) else np.zeros(0, bool)

    def n(self) -> int:
        return len(self.code) - self.skip

    def ones(self) -> tuple[np.ndarray, np.ndarray]:
        """(words, counts)"""
        count = np.bincount(self.code[self.skip :], minlength=len(self.words))
        some = np.flatnonzero(count)
        return some, count[some]

    def twos(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first words, second words, counts)"""
        at = np.flatnonzero(self.joined)
        at = at[at + 1 >= self.skip]
        both, count = np.unique(self.code[at] * len(self.words) + self.code[at + 1], return_counts=True)
        return both // max(1, len(self.words)), both % max(1, len(self.words)), count

    def threes(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, second and third words, counts) of phrases both of whose parts the filter lets through."""
        at = np.flatnonzero(self.joined)
        let = np.zeros(len(self.code), bool)
        hashes = word_hashes(self.words)
        let[at] = passes(bits, phrase_places(hashes[self.code[at]], hashes[self.code[at + 1]]))
        at = np.flatnonzero(let[:-1] & let[1:]) if len(let) else at
        at = at[at + 2 >= self.skip]
        first, place = np.unique(self.code[at] * len(self.words) + self.code[at + 1], return_inverse=True)
        whole, count = np.unique(place.ravel() * len(self.words) + self.code[at + 2], return_counts=True)
        pair = first[whole // max(1, len(self.words))]
        return pair // max(1, len(self.words)), pair % max(1, len(self.words)), whole % max(1, len(self.words)), count


def word_hashes(words: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    buffer = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    return span_hashes(buffer, offsets[:-1], offsets[1:])


def phrase_places(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The bits of phrases of two words, a row a hash."""
    whole = mix64(first * np.uint64(0x9E3779B97F4A7C15) + mix64(second))
    return np.stack([(whole >> np.uint64(32 * i)) % np.uint64(FILTER_BITS) for i in range(FILTER_HASHES)]).astype(np.int64)


def passes(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0)


def _runs_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Counts]]:
    """(language, counts) of runs of about RUN bytes; short texts of a language are counted together."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def flushed() -> Iterator[tuple[str, Counts]]:
        for lang, texts in held.items():
            yield lang, Counts(b"\n".join(texts))
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
            name, clean = lang.as_py(), text.as_py().lower().translate(_CLEAN)
            if len(clean) > RUN:
                for before, part in runs(clean, RUN):
                    yield name, Counts(part, before)
                continue
            held.setdefault(name, []).append(clean)
            size += len(clean) + 1
            if size > RUN:
                yield from flushed()
                size = 0
    yield from flushed()


def _rows(lang: str, words: pa.Array, codes: list[np.ndarray], count: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(count), 1 << 16):
        some = slice(at, at + (1 << 16))
        n = len(count[some])
        columns = [words.take(pa.array(c[some])).cast(pa.string()) for c in codes] + [pa.nulls(n, pa.string())] * (width - len(codes))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), *columns, pa.array(count[some], pa.int64())], names=["lang", *(f"w{i + 1}" for i in range(width)), "c"])


def short_counts(texts: DataFrame, least: int) -> DataFrame:
    """(lang, w1, w2, f) of words and of phrases of two, of those with f >= least; the number of all words stands in a row without words. texts is (lang, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, run in _runs_by_language(batches):
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([run.n()], pa.int64())], names=["lang", "w1", "w2", "c"])
            for *codes, count in (run.ones(), run.twos()):
                yield from _rows(lang, run.words, codes, count, 2)

    counted = in_arrow(texts, work, "lang string, w1 string, w2 string, c long").groupBy("lang", "w1", "w2").agg(F.sum("c").alias("f"))
    return counted.where((F.col("f") >= least) | F.col("w1").isNull())


def frequent_filter(short: DataFrame) -> np.ndarray:
    """The filter's bytes, FILTER_BITS / 8 whatever the number of phrases, put together in tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (word_hashes(pa.array(batch.column(i).cast(pa.binary()).to_pylist(), pa.binary())) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(phrase_places(one, two).ravel() + 1)], names=["place"])

    places = in_arrow(short.where("w2 is not null").select("w1", "w2"), work, "place long")
    maps = places.groupBy(F.bitmap_bucket_number("place").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in maps.toLocalIterator():  # FILTER_BITS / BITMAP rows at most
        part = np.frombuffer(row["bits"], np.uint8)
        at = (row["at"] - 1) * BITMAP // 8
        bits[at : at + len(part)] = part
    return bits


def long_counts(texts: DataFrame, bits: np.ndarray, least: int) -> DataFrame:
    """(lang, w1, w2, w3, f) of phrases of three words with f >= least."""
    held = texts.sparkSession.sparkContext.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, run in _runs_by_language(batches):
            *codes, count = run.threes(held.value)
            yield from _rows(lang, run.words, codes, count, 3)

    return in_arrow(texts, work, "lang string, w1 string, w2 string, w3 string, c long").groupBy("lang", "w1", "w2", "w3").agg(F.sum("c").alias("f")).where(F.col("f") >= least)


def read_in_order(grams: DataFrame, order: list[str], one: str, two: str) -> DataFrame:
    """grams with the counts of what each begins with in this order: `one` of its first word, `two` of its first two.

    A word stands before the phrases that begin with it, a phrase of two before those of three, and none is missing, as parts are no rarer than the whole: the
    last one read is the one.
    """
    dealt = cut(grams.repartitionByRange("lang", *order).withColumn("_part", F.spark_partition_id()), "stream")
    is_one, is_two = F.col(order[1]).isNull(), F.col(order[1]).isNotNull() & F.col(order[2]).isNull()
    last = lambda kind, names: F.max(F.when(kind, F.struct("lang", *names, "f")))["f"]
    ends = dealt.groupBy("_part").agg(last(is_one, order[:1]).alias("_one"), last(is_two, order[:2]).alias("_two"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a partition
    carried = ends.select("_part", *(F.last(c, ignorenulls=True).over(before).alias(c) for c in ("_one", "_two")))
    so_far = Window.partitionBy("_part").orderBy("lang", *order).rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda kind: F.last(F.when(kind, F.col("f")), ignorenulls=True).over(so_far)
    read = dealt.withColumn(one, seen(is_one)).withColumn(two, seen(is_two)).join(F.broadcast(carried), "_part")
    return read.withColumn(one, F.coalesce(one, "_one")).withColumn(two, F.coalesce(two, "_two")).drop("_part", "_one", "_two")


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1,000,000 a a / (l r)), exact for counts below 1e14."""
    wide = lambda c: c.cast("decimal(14,0)")
    over = (wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
    return F.call_function("div", over, (wide(l) * wide(r)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = 10, percent: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of two and three words.

    A phrase occurs `least` times or more; it is left out if a phrase of three words that holds it occurs percent / 100 times as often or more, whether that one is left out or not.
    """
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    with scratch(docs.sparkSession):
        short = cut(short_counts(texts, least), "short")
        long = cut(long_counts(texts, frequent_filter(short), least), "long")
        grams = short.where("w1 is not null").withColumn("w3", F.lit(None).cast("string")).unionByName(long)
        left = read_in_order(grams, ["w1", "w2", "w3"], "left_1", "left_2")
        turned = left.withColumn("z1", F.coalesce("w3", "w2", "w1")).withColumn("z2", F.when(F.col("w3").isNotNull(), F.col("w2")).when(F.col("w2").isNotNull(), F.col("w1"))).withColumn("z3", F.when(F.col("w3").isNotNull(), F.col("w1")))
        both = cut(read_in_order(turned, ["z1", "z2", "z3"], "right_1", "right_2").where("w2 is not null"), "read")
        threes = both.where("w3 is not null")
        # A phrase of two has at most 100 / percent such phrases on each side.
        held = [threes.where(F.col("f") * 100 >= F.col(of) * percent).select("lang", *(F.col(x).alias(y) for x, y in zip(names, ("w1", "w2")))) for of, names in (("left_2", ("w1", "w2")), ("right_2", ("w2", "w3")))]
        within = held[0].unionByName(held[1]).distinct()
        twos = both.where("w3 is null").join(within.hint("merge"), ["lang", "w1", "w2"], "left_anti").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.col("left_1").alias("l"), F.col("right_1").alias("r"))
        twos = twos.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
        early, late = (score(F.col("f"), F.col(x), F.col(y)) for x, y in (("left_1", "right_2"), ("left_2", "right_1")))
        cuts = threes.withColumn("_early", early).withColumn("_late", late)
        first = F.col("_early") <= F.col("_late")
        threes = cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), F.when(first, F.col("left_1")).otherwise(F.col("left_2")).alias("l"), F.when(first, F.col("right_2")).otherwise(F.col("right_1")).alias("r"), F.least("_early", "_late").alias("score"))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = twos.unionByName(threes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        total = short.where("w1 is null").select("lang", F.col("f").alias("n"))
        return cut(ranked.join(hinted(total, BROADCAST_ROWS), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "ranked", keep=True)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two and three words with ten occurrences or more, the first 2000 of each language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
