"""Token counts by section, from offsets: each whole text is encoded once, and its tokens' spans are joined to the sections' spans.

The tokenizer is a byte-level BPE, whose tokens' bytes are the text's: running sums of token lengths are the spans. Sections are
character spans in order: those of a column of the caller's (title, body, fields of a record, ...), or the lines, each with its line break. Tokens and
sections are intervals on one axis, so the join is two binary searches for each token. A token inside one section is that section's.
A token that crosses a boundary is allocated by an explicit rule:

    first      the first section that holds any of its bytes
    last       the last section that holds any of its bytes
    majority   the section that holds most of its bytes; ties go to the earlier one

Counts of a document's sections add up to the tokens of the whole text if the sections cover it; tokens that meet no section are
counted for none. Sections of a column go by start, then end, then name; one that begins before the end of those before it begins there instead, and what lies outside
the text is left out; sections that are null or have a null end are skipped, and empty ones have no tokens. Null and empty texts have one empty line without
tokens. Rows that repeat a doc_id, or have none, give rows of their own. Columns besides id, text and sections are ignored.

The tokenizer's pattern can't take very long runs of white space in one go. It splits such a run before its last character, or nowhere if it
ends the text, so a long run is cut out there and encoded as the one piece that it is; the ids are those of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.llm.shared import in_arrow, pieces_of
from segmentry.llm.wordbpe import vocabulary

RULES = ("first", "last", "majority")
_known: dict[str, tuple] = {}


def byte_encoder(file: str):
    """The tokenizer of a rank file and its tokens' lengths in bytes; one a worker process."""
    if file not in _known:
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary(file), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _known[file] = tiktoken.Encoding(file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _known[file]


#: White space of the pattern (a fixed value), and the run of it that is cut out.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 100_000


def encoded(encoding, text: str, long_run: int = LONG_RUN) -> np.ndarray:
    """The ids of a text, whatever runs of white space it has."""
    if len(text) < long_run:
        return encoding.encode_to_numpy(text, disallowed_special=())
    parts, at = [], 0
    for run in re.finditer(f"[{BLANKS}]{{{long_run},}}", text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        parts.append(encoding.encode_to_numpy(text[at : run.start()], disallowed_special=()))
        parts.append(np.array(encoding._encode_single_piece(text[run.start() : stop].encode()), np.uint32))
        at = stop
    return np.concatenate([*parts, encoding.encode_to_numpy(text[at:], disallowed_special=())])


def line_bounds(text: bytes) -> np.ndarray:
    """Byte offsets where lines begin, and the end: a line holds the break that ends it."""
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    ends = breaks if len(breaks) and breaks[-1] == len(text) else np.append(breaks, len(text))
    return np.concatenate(([0], ends))


def in_order(spans: list[dict] | None, chars: int) -> list[tuple[str | None, int, int]]:
    """(name, start, end) in characters of a text of so many: in order, without overlap, inside the text."""
    whole = [(s["start"], s["end"], s["name"]) for s in spans or () if s and s["start"] is not None and s["end"] is not None]
    out, at = [], 0
    for start, end, name in sorted(whole, key=lambda s: (s[0], s[1], s[2] is not None, s[2] or "")):
        start = min(max(start, at, 0), chars)
        end = min(max(end, start), chars)
        out.append((name, start, end))
        at = max(at, end)
    return out


def allocate(token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; token i spans [token_ends[i - 1], token_ends[i]), section j spans [starts[j], ends[j])."""
    counts = np.zeros(len(starts), np.int64)
    full = np.flatnonzero(ends > starts)
    starts, ends = starts[full], ends[full]
    begin = np.concatenate(([0], token_ends[:-1]))
    low = np.searchsorted(ends, begin, side="right")  # the first section that ends after the token begins
    high = np.searchsorted(starts, token_ends, side="left") - 1  # the last that begins before the token ends
    chosen = np.where(low <= high, low if rule != "last" else high, -1)
    if rule == "majority":
        for i in np.flatnonzero(low < high).tolist():
            across = np.arange(low[i], high[i] + 1)
            held = np.minimum(ends[across], token_ends[i]) - np.maximum(starts[across], begin[i])
            chosen[i] = across[int(held.argmax())]
    counts[full] = np.bincount(chosen[chosen >= 0], minlength=len(full))
    return counts


def count_tokens(docs: DataFrame, rule: str = "majority", tokenizer: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text", sections: str | None = None) -> DataFrame:
    """doc_id, section (from 0), name, start, end (characters), n_tokens for each section of each row.

    sections: a column of array<struct<name: string, start: long, end: long>>; without it sections are lines and have no name.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spans = docs[sections] if sections else F.lit(None)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), spans.cast("array<struct<name: string, start: bigint, end: bigint>>").alias("spans"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = byte_encoder(tokenizer)
        for part, texts in pieces_of(batches):
            names, chars, counts, numbers = [], [], [], []
            for text, own in zip(texts, part.column(2).to_pylist() if sections else [None] * len(texts)):
                ends = np.cumsum(sizes[encoded(encoding, text.decode())])
                first = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # the byte where each character begins
                if sections:
                    named = in_order(own, len(first))
                    names.extend(n for n, _, _ in named)
                    at = np.array([(a, b) for _, a, b in named], np.int64).reshape(-1, 2)
                    edge = np.append(first, len(text))[at]
                else:
                    bounds = line_bounds(text)
                    edge = np.stack((bounds[:-1], bounds[1:]), axis=1)
                    at = np.searchsorted(first, edge)
                    names.extend([None] * len(at))
                counts.append(allocate(ends, edge[:, 0], edge[:, 1], rule))
                chars.append(at)
                numbers.append(len(at))
            place = np.concatenate(chars)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.repeat(np.arange(len(texts)), numbers))),
                    pa.array(np.concatenate([np.arange(n) for n in numbers]), pa.int32()),
                    pa.array(names, pa.string()),
                    pa.array(place[:, 0], pa.int64()),
                    pa.array(place[:, 1], pa.int64()),
                    pa.array(np.concatenate(counts), pa.int64()),
                ],
                names=["doc_id", "section", "name", "start", "end", "n_tokens"],
            )

    return in_arrow(rows, work, "doc_id long, section int, name string, start long, end long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token that crosses lines goes to the one that holds most of it."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("name")
