"""Language identification as a mixture: expectation-maximisation of each text's language proportions from n-gram likelihoods.

Learning counts hashed letter trigrams by language over all rows to learn from, as Spark sums of what each task counted; the
table of log probabilities (buckets x languages) is all that reaches the driver. So that it is bounded, at most `most` languages are learned, those of
most documents, ties to the first in order. A text's words have a likelihood in each language, the
product of their trigrams'; EM finds the proportions of languages that make the words likeliest. Equal words of a text are one with a count. Rounds over all languages,
speeded by squared extrapolation, go on until they add less than TOLERANCE to the log likelihood, or can't add more by its slope. The set of languages is
chosen among the m most frequent for m = 1, 2, ..., each fitted to the same tolerance and penalised for each language by half the log of the number of words;
the search of a text ends where one more language gains nothing.
The prediction is the language with the largest share in the chosen set, the score that share.

Shares are among the known languages whatever the text. Whether a text is in any of them is told by its mean log likelihood a trigram:
texts of a language average what its own table expects of itself, those without a language that of uniform buckets, and the floor lies halfway.

A text that is null or without letters, and any text if nothing could be learned, is `und` with score 0. Ties go to the language first in
order. Rows that repeat a doc_id are predicted each; a row without doc_id is predicted, but never held out or
learned from. lang, source and doc_id are no inputs of a prediction. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.llm.shared import in_arrow, pieces_of

BUCKETS = 1 << 15
SMOOTHING = 0.5
#: Languages that a model knows at most.
LANGUAGES = 256
#: A fit ends where rounds add less to the log likelihood of the whole text, or are proved to.
TOLERANCE = 1e-2
#: Numbers (words or trigrams by languages) that are held at a time for texts together, and words of a long text in a block.
CELLS, BLOCK = 1 << 22, 1 << 14


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in lower case: bucket of the trigram around each letter, the word it is in, and the text of each word. Words end at non-letters, which count as one blank."""
    codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le"), np.uint32)
    letter = _is_letter()[codes]
    shown = np.where(letter, codes, 0).astype(np.uint32)
    at = np.flatnonzero(letter)
    mixed = shown[at - 1] * np.uint32(0x9E3779B1) ^ (shown[at] * np.uint32(0x85EBCA77) + shown[at + 1] * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    buckets = (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    begins = letter[at] & ~letter[at - 1]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(np.concatenate(([1], lengths[:-1] + 1)))
    return buckets, np.cumsum(begins) - 1, np.searchsorted(starts, at[begins], side="right") - 1


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # log probability, (buckets, languages)

    def floor(self) -> tuple[float, float]:
        """The least mean log likelihood a trigram of a known language, and what it falls by for a text of one trigram: two deviations."""
        table = self.table.astype(float)
        p = np.exp(table)
        p -= p.min(axis=0)  # what was learned, without the smoothing
        p /= np.maximum(p.sum(axis=0), 1e-300)
        mean = (p * table).sum(axis=0)
        deviation = np.sqrt((p * (table - mean) ** 2).sum(axis=0))
        return float(mean.min() - np.log(BUCKETS)) / 2, 2 * float(deviation.max())

    def shares(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): proportions in the chosen set, 0 elsewhere; all 0 for a text without letters."""
        return self.judged(texts)[0]

    def judged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """shares, and whether each text, its words each in the language likeliest for it, is likely enough to be in known languages."""
        out, known = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        if not self.languages:
            return out, known
        least, slack = self.floor()
        counted = distinct_words([t.lower() for t in texts])
        sizes = np.fromiter(map(len, counted), np.int64, len(counted))
        group = np.cumsum(sizes) * len(self.languages) // CELLS
        full = np.flatnonzero(sizes > 0)
        for own in np.split(full, np.flatnonzero(np.diff(group[full])) + 1):
            if not len(own):
                continue
            buckets, word, _ = trigrams([" ".join(counted[i]) for i in own])
            words = sizes[own]
            times = np.fromiter(chain.from_iterable(counted[i].values() for i in own), float, int(words.sum()))
            like = self.likelihoods(buckets, word, len(times))
            top = like.max(axis=1, keepdims=True)
            letters = run_sums(times * np.bincount(word, minlength=len(times)), words)
            known[own] = run_sums(times * top[:, 0], words) >= letters * least - slack * np.sqrt(letters)
            like -= top
            out[own] = mixtures(np.exp(like, out=like), words, times)
        return out, known

    def likelihoods(self, buckets: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """(n, languages): log likelihood of each word, summed over so many of its trigrams at a time that memory is bounded."""
        out, step = np.zeros((n, len(self.languages)), np.float32), max(1, CELLS // len(self.languages))
        for a in range(0, len(buckets), step):
            part = word[a : a + step]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            out[part[first]] += np.add.reduceat(self.table[buckets[a : a + step]], first, axis=0)
        return out


def distinct_words(texts: list[str]) -> list[Counter]:
    """Of texts in lower case: how often each word occurs. Words end at non-letters."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    shown = np.where(_is_letter()[codes], codes, 32).astype(np.uint32)
    shown[np.cumsum([len(t) + 1 for t in texts[:-1]], dtype=np.int64) - 1] = 10
    return [Counter(x.split()) for x in shown.tobytes().decode("utf-32-le").split("\n")]


def run_sums(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, np.concatenate(([0], np.cumsum(words)[:-1])), axis=0)


def em_round(like: np.ndarray, words: np.ndarray, times: np.ndarray, size: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shares after a round of EM, log likelihood before it, bound on what all further rounds can add) of each text.

    like: (words, languages) of texts one after the other; words: their numbers of distinct words; times: how often each occurs; size: the sums of times.
    The log likelihood is concave, so its slope towards the steepest language bounds the rest.
    """
    if len(words) == 1:  # a text alone, which may be very long, in blocks
        pull, score = np.zeros((1, like.shape[1])), np.zeros(1)
        for i in range(0, len(like), BLOCK):
            part, n = like[i : i + BLOCK].astype(float), times[i : i + BLOCK]
            total = np.maximum(part @ shares[0], 1e-300)
            score += n @ np.log(total)
            pull += (n / total) @ part
    else:
        total = np.maximum(np.einsum("ij,ij->i", like, np.repeat(shares, words, axis=0)), 1e-300)
        score = run_sums(times * np.log(total), words)
        pull = run_sums(like * (times / total)[:, None], words)
    pull /= size[:, None]
    left = size * (np.where(shares > 0, pull, 0).max(axis=1) - 1)
    now = shares * pull
    return now / np.maximum(now.sum(axis=1, keepdims=True), 1e-300), score, left


def converged(like: np.ndarray, words: np.ndarray, times: np.ndarray, size: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares, log likelihood) of each text when rounds of EM add less than TOLERANCE; texts that are done leave.

    Two rounds show where a text's shares are heading; they leap as far as squared extrapolation says, and a third round follows. A leap that loses is not taken.
    """
    shares, score = shares.copy(), np.full(len(words), -np.inf)
    at = np.arange(len(words))
    while len(at):
        start = shares[at]
        one, now, left = em_round(like, words, times, size, start)
        moving = (left >= TOLERANCE) & (now - score[at] >= TOLERANCE)
        score[at] = now
        if not moving.all():
            rows = np.repeat(moving, words)
            at, like, words, times, size, start, one = at[moving], like[rows], words[moving], times[rows], size[moving], start[moving], one[moving]
            if not len(at):
                break
        two, least, _ = em_round(like, words, times, size, one)
        step, bend = one - start, two - 2 * one + start
        length = np.maximum(1, np.linalg.norm(step, axis=1) / np.maximum(np.linalg.norm(bend, axis=1), 1e-300))[:, None]
        length = np.minimum(length, 1e6)
        leap = start + 2 * length * step + length**2 * bend
        leap = np.where(leap > 0, leap, two / 10)
        leap /= leap.sum(axis=1, keepdims=True)
        three, reached, _ = em_round(like, words, times, size, leap)
        shares[at] = np.where((reached >= least)[:, None], three, two)
    return shares, score


def mixtures(like: np.ndarray, words: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """(texts, languages): proportions in the chosen set of each text, 0 elsewhere. Arguments as in em_round; without times each word occurs once."""
    n, languages = len(words), like.shape[1]
    times = np.ones(len(like)) if times is None else times
    size = run_sums(times, words)
    shares, _ = converged(like, words, times, size, np.full((n, languages), 1 / languages))
    order = np.argsort(-shares, axis=1, kind="stable")
    shares = np.take_along_axis(shares, order, axis=1)
    best, best_score, at = np.zeros_like(shares), np.full(n, -np.inf), np.arange(n)
    own = np.zeros((0, 0))
    for m in range(1, languages + 1):
        if own.shape[1] < m:  # the likelihoods of twice as many languages, in order of their shares
            own = np.take_along_axis(like, np.repeat(order[at, : 2 * m], words, axis=0), axis=1)
        some = np.maximum(shares[at, :m], 1e-12)
        tried, score = converged(own[:, :m], words, times, size, some / some.sum(axis=1, keepdims=True))
        score -= 0.5 * (m - 1) * np.log(size)
        better = score > best_score[at]
        won = at[better]
        best[won, :m], best_score[won] = tried[better], score[better]
        if not better.all():
            rows = np.repeat(better, words)
            at, like, own, words, times, size = won, like[rows], own[rows], words[better], times[rows], size[better]
            if not len(at):
                break
    out = np.zeros((n, languages))
    np.put_along_axis(out, order, best, axis=1)
    return out


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = LANGUAGES) -> LanguageModel:
    """Trigram tables of the languages named in docs (`most` at most), from all their texts."""
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")).where("lang is not null and text is not null")
    names = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()]
    rows = rows.where(F.col("lang").isin(names))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for part, texts in pieces_of(batches):
            langs = np.array(part.column(0).to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                buckets, _, _ = trigrams([t.decode().lower() for t, x in zip(texts, langs) if x == lang])
                seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                seen[lang] += np.bincount(buckets, minlength=BUCKETS)
        for lang, counts in seen.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], names=["lang", "bucket", "n"])

    counts = in_arrow(rows, work, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).selectExpr("lang", "c.bucket as bucket", "c.n as n").toArrow()  # a row a language, of BUCKETS numbers at most
    each = sorted(zip(found.column("lang").to_pylist(), found.column("bucket"), found.column("n")), key=lambda x: x[0])
    languages = tuple(lang for lang, _, _ in each)
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    for k, (_, bucket, n) in enumerate(each):
        table[bucket.values.to_numpy(), k] += n.values.to_numpy()
    return LanguageModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, shares (language to proportion) for each row."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for part, texts in pieces_of(batches):
            shares = known.shares([t.decode() for t in texts])
            best = shares.argmax(axis=1) if known.languages else np.zeros(len(texts), int)
            score = shares.max(axis=1, initial=0)
            names = [known.languages[k] if s > 0 else "und" for k, s in zip(best.tolist(), score.tolist())]
            mixes = [{known.languages[k]: float(row[k]) for k in np.flatnonzero(row).tolist()} for row in shares]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0)), pa.array([list(m.items()) for m in mixes], pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "lang_pred", "score", "shares"],
            )

    return in_arrow(rows, work, "doc_id long, lang_pred string, score double, shares map<string,double>")


def learned_from(docs: DataFrame) -> LanguageModel:
    """The model of all documents that are not held out."""
    return learn(docs.where(docs["doc_id"].isNotNull() & ~held_out(docs["doc_id"])))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learned_from(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
