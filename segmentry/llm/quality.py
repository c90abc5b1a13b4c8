"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One vector of weights over hashed text features gives a text's position; ordered thresholds cut it into grades:
P(grade >= k) = sigmoid(position - threshold_k). The expected grade is the sum of these tail probabilities over k, and
the tail of the best grade decides what is kept. Features are the words and the runs of symbols that a text holds (each
once, whole), the symbol that each run begins with and the power of two that its length reaches, and how much of the text is symbols,
repeats and distinct words.

Grades of the labels: 0 toxic, 1 of low quality, 2 neither. The model is fitted on a bounded sample of labelled rows (`most`,
the labelled documents least by a hash of their id, and of rows that repeat a doc_id the text first in order); every document is scored.

Null and empty texts have no feature but those of emptiness. Labels that are null or repeat a document count by their worst grade.
Without labels, every text has the best grade and is kept. Rows that repeat a doc_id, or have none, are scored each. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.llm.shared import in_arrow, mix64, pieces_of, span_hashes

BITS = 20
GRADES = 3
#: Labelled rows that the fit takes at most.
SAMPLE = 12_000
#: Texts of the sample that must hold a feature for it to have a weight.
LEAST_TEXTS = 3
STEPS, RATE, DECAY = 300, 0.1, 1e-4
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, in order: hashed words and symbol runs, and binned shares."""
    buffer = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    kind = _KIND[buffer]
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0), append=np.uint8(0)))
    starts, ends = edge[:-1], edge[1:]
    shown = kind[starts] > 0
    starts, ends = starts[shown], ends[shown]
    symbol = kind[starts] == 2
    hashes = span_hashes(buffer, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    shape = mix64(buffer[starts[symbol]].astype(np.uint64) << np.uint64(8) | np.log2(ends[symbol] - starts[symbol]).astype(np.uint64)) if len(starts) else hashes
    begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    text = np.searchsorted(begin, starts, side="right") - 1
    n = len(texts)
    words = np.bincount(text[~symbol], minlength=n)
    plain = np.isin(buffer[starts], [44, 46]) & (ends - starts == 1) & symbol
    symbols = np.bincount(text[symbol & ~plain], minlength=n)
    word, owner = hashes[~symbol], text[~symbol]
    same = np.bincount(owner[1:][(word[1:] == word[:-1]) & (owner[1:] == owner[:-1])], minlength=n) if len(word) else np.zeros(n)
    of = lambda owner, h: owner << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique(of(text, hashes))
    distinct = np.bincount(key >> BITS, minlength=n)
    key = np.unique(np.concatenate((key, of(text[symbol], shape))))
    whole = np.maximum(words, 1)
    bins = [np.minimum(10 * x / whole, 10).astype(np.uint64) for x in (symbols, 4 * same, distinct)] + [np.minimum(np.log2(whole), 15).astype(np.uint64)]
    shares = [(((b + np.uint64(16 * i + 1)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)) for i, b in enumerate(bins)]
    rows = np.concatenate([key >> BITS, *[np.arange(n)] * len(shares)])
    return rows, np.concatenate([key & ((1 << BITS) - 1), *(x.astype(np.int64) for x in shares)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than grades

    def tails(self, texts: list[bytes]) -> np.ndarray:
        """(texts, grades - 1): probabilities of grade 1 or more, 2 or more, ..."""
        rows, feature = features(texts)
        position = np.bincount(rows, self.weights[feature], minlength=len(texts))
        return _sigmoid(position[:, None] - self.thresholds[None, :])


def fit(rows: np.ndarray, feature: np.ndarray, grades: np.ndarray) -> OrdinalModel:
    """Full-batch Adam on the penalised likelihood of the grades."""
    n = len(grades)
    if not n or len(np.unique(grades)) < 2:
        return OrdinalModel(np.zeros(1 << BITS, np.float32), np.full(GRADES - 1, -10.0))
    used = np.flatnonzero(np.bincount(feature, minlength=1 << BITS) >= LEAST_TEXTS)
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    known = place[feature] >= 0
    rows, column = rows[known], place[feature[known]]
    shares = np.bincount(grades, minlength=GRADES) / n
    below = np.clip(np.cumsum(shares)[:-1], 1e-3, 1 - 1e-3)
    value = np.concatenate((np.zeros(len(used)), np.log(below / (1 - below))))
    first, second = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, STEPS + 1):
        cuts = np.concatenate(([-np.inf], np.maximum.accumulate(value[len(used) :]), [np.inf]))
        position = np.bincount(rows, value[column], minlength=n)
        upper, lower = _sigmoid(position - cuts[grades]), _sigmoid(position - cuts[grades + 1])
        upper[grades == 0], lower[grades == GRADES - 1] = 1.0, 0.0
        mass = np.maximum(upper - lower, 1e-9)
        along = 1 - upper - lower  # of the log likelihood by position
        up, down = upper * (1 - upper) / mass, lower * (1 - lower) / mass
        cut_slope = np.array([np.sum(down[grades == k - 1]) - np.sum(up[grades == k]) for k in range(1, GRADES)])
        slope = np.concatenate((np.bincount(column, along[rows], minlength=len(used)), cut_slope)) / n
        slope[: len(used)] -= DECAY * value[: len(used)]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        value += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = value[: len(used)]
    return OrdinalModel(weights, np.maximum.accumulate(value[len(used) :]))


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> OrdinalModel:
    """The model of at most `most` labelled documents."""
    grade = F.when(F.coalesce("toxic", F.lit(0)) != 0, 0).when(F.coalesce("quality", F.lit(1)) == 0, 1).otherwise(GRADES - 1)
    graded = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(grade).alias("grade"))
    sample = graded.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text")).join(F.broadcast(sample), "id")
    rows = rows.groupBy("id", "grade").agg(F.min("text").alias("text")).select("grade", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces_of(batches):
            text, feature = features(texts)
            lists = np.split(feature[np.argsort(text, kind="stable")], np.cumsum(np.bincount(text, minlength=len(texts)))[:-1])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype("<i4").tobytes() for x in lists], pa.binary())], names=["grade", "features"])

    found = in_arrow(rows, work, "grade int, features binary").toArrow()  # `most` rows at most
    lists = [np.frombuffer(x, "<i4") for x in found.column("features").to_pylist()]
    text = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return fit(text, np.concatenate(lists).astype(np.int64) if lists else text, np.array(found.column("grade").to_pylist(), np.int64))


def classify(docs: DataFrame, model: OrdinalModel, keep_at: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_best (probability of the best grade), kept (p_best >= keep_at) for each row."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces_of(batches):
            tails = held.value.tails(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= keep_at)], names=["doc_id", "expected_grade", "p_best", "kept"])

    return in_arrow(rows, work, "doc_id long, expected_grade double, p_best double, kept boolean")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
