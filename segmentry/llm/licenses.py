"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Units are the lines of a text, the text as a whole, and windows of words, over lines and inside them, so that a notice wrapped over lines of a
long document and one between other sentences of a line are found too. A template's windows have its own number of words and eight others, from the least to
the largest that can reach the threshold, so that a notice with words put in or left out meets a window of about its size. A window that touches lines
which hold a licence by themselves is a unit only if it goes over several lines, cuts none of those, and its coefficient is above theirs. Of windows that overlap
the best is a unit, the others are none; ties go to the template first in order, then to the earlier and the shorter window. Words are runs of a-z and 0-9 after lower-casing A-Z. The Dice coefficient of bigram sets A and B is
2|A n B| / (|A| + |B|); at threshold t only templates with |A| t / (2 - t) <= |B| <= |A| (2 - t) / t can reach it, which
prunes templates by size, and units whose bigrams in common with any template are too few for their size are passed over. A window has to
hold |B| t / (2 - t) bigrams of its template at least.

Null and empty texts have no licence. Ties go to the template first in order, then to the earlier unit. A row
without doc_id gives a row without doc_id; rows that repeat one give a row each. Columns besides id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from segmentry.llm.shared import in_arrow, pieces_of, span_hashes

# Notices by which works state common licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("mit", "Released under the MIT License."),
    ("mit", "This software is licensed under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "Released under the BSD License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    # Whole licences.
    (
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        'notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO '
        "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
)
#: Widths of windows on either side of a template's own.
STEPS = 4
WORD = re.compile(rb"[a-z0-9]+")
_KEEP = np.zeros(256, bool)
_KEEP[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True


def bigrams(text: bytes) -> frozenset[tuple[bytes, bytes]]:
    words = WORD.findall(text.lower())
    return frozenset(zip(words, words[1:]))


def best_template(unit: frozenset, templates: list[tuple[str, frozenset]], percent: int) -> tuple[int, int, int] | None:
    """(template, shared, sizes) of the best Dice coefficient of at least percent."""
    best = None
    for i, (_, other) in enumerate(templates):
        both = len(unit) + len(other)
        if 200 * min(len(unit), len(other)) < percent * both:  # the size bounds
            continue
        shared = len(unit & other)
        if 200 * shared >= percent * both and (best is None or shared * best[2] > best[1] * both):
            best = (i, shared, both)
    return best


def hopeful(texts: list[bytes], known: np.ndarray, percent: int, least: int, largest: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, tuple[np.ndarray, ...]]:
    """(text, line number in it) of the lines with enough bigrams in common with some template to reach the threshold; the texts that have, as a
    whole, enough of them and are not too large for any template; and of each known
    bigram its number, text, place in the text's words, and the lines of its two words.

    A unit with d distinct bigrams, h of them (repeats counted) known, reaches at most 2h / (d + least), least being the smallest template's size,
    and none if d is above largest (200 - percent) / percent.
    """
    none = np.zeros(0, np.int64)
    buffer = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    if not len(buffer):
        return (none, none), none, (none,) * 5
    edge = np.diff(np.concatenate(([0], _KEEP[buffer].view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(starts) < 2:
        return (none, none), none, (none,) * 5
    words = span_hashes(buffer, starts, ends)
    line = np.cumsum(buffer == 10)[starts]
    pair = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
    place = np.minimum(np.searchsorted(known, pair), len(known) - 1)
    met = known[place] == pair
    first = np.cumsum([0] + [t.count(b"\n") + 1 for t in texts])
    at = np.flatnonzero(met)
    text = np.searchsorted(first, line[at], side="right") - 1
    one = line[at + 1] < first[text + 1]  # both words are of one text
    at, text = at[one], text[one]
    bits = place[at], text, at - np.searchsorted(line, first[text]), line[at] - first[text], line[at + 1] - first[text]
    met_in = np.bincount(text, minlength=len(texts))
    edge = np.searchsorted(line, first)  # the first word of each text
    whole = []
    for t in np.flatnonzero(200 * met_in >= percent * (least + 1)).tolist():
        distinct = len(np.unique(pair[edge[t] : edge[t + 1] - 1]))
        if 200 * met_in[t] >= percent * (distinct + least) and percent * distinct <= (200 - percent) * largest:
            whole.append(t)
    inside = line[:-1] == line[1:]
    hits = np.bincount(line[:-1][inside & met], minlength=int(line.max(initial=0)) + 1)
    few = np.flatnonzero(200 * hits >= percent * (least + 1))
    if not len(few):
        return (none, none), np.array(whole, np.int64), bits
    pair, line = pair[inside], line[:-1][inside]
    several = np.isin(line, few)
    line, pair = line[several], pair[several]
    order = np.lexsort((pair, line))
    line, pair = line[order], pair[order]
    new = np.append(True, (line[1:] != line[:-1]) | (pair[1:] != pair[:-1]))
    sizes = np.bincount(line[new], minlength=len(hits))
    few = few[200 * hits[few] >= percent * (sizes[few] + least)]
    text = np.searchsorted(first, few, side="right") - 1
    return (text, few - first[text]), np.array(whole, np.int64), bits


def widths_of(text: str, percent: int) -> list[int]:
    """The numbers of words of a template's windows: its own, and this times powers of a step that lead in STEPS to the largest and least sizes of bigram sets which can reach the threshold."""
    n, most = len(WORD.findall(text.lower().encode())), (200 - percent) / percent
    return sorted({max(2, round(n * most ** (k / STEPS))) for k in range(-STEPS, STEPS + 1)})


def hopeful_windows(bits: tuple[np.ndarray, ...], taken: list[tuple[int, int]], owns: np.ndarray, widest: list[int], needs: list[int]) -> dict[int, list[tuple[int, int, int]]]:
    """Of each text that has some: (template, first and last place of its bigrams) of the templates with enough of their bigrams in some window, away from the (text, line) taken, which no window can better.

    owns has a row a template and a column a known bigram. Repeats count, so that no window that reaches the threshold is left out.
    """
    number, text, word, line, next_line = bits
    if taken and len(text):
        span = int(next_line.max()) + 2
        used = np.array([t * span + x for t, x in taken if x < span])
        free = ~(np.isin(text * span + line, used) | np.isin(text * span + next_line, used))
        number, text, word = number[free], text[free], word[free]
    found: dict[int, list[tuple[int, int, int]]] = {}
    for i, (width, need) in enumerate(zip(widest, needs)):
        own = owns[i, number]
        t, w = text[own], word[own]
        low, high = np.arange(max(0, len(t) - need + 1)), np.arange(need - 1, len(t))
        near = (t[low] == t[high]) & (w[high] - w[low] <= width - 2)
        low, high = low[near], high[near]
        new = np.flatnonzero(np.diff(t[low], prepend=-1))
        for x, a, z in zip(t[low][new].tolist(), w[low][new].tolist(), w[high][np.append(new[1:], len(low))[: len(new)] - 1].tolist()):
            found.setdefault(x, []).append((i, a, z))
    return found


def distinct_in_windows(before: np.ndarray, places: np.ndarray, begin: int, n: int, size: int) -> np.ndarray:
    """Of the n windows of `size` bigrams that start at begin, begin + 1, ...: how many different bigrams of those at places each has. before: the place of the same bigram before each one, or -1.

    A bigram counts in a window where it stands in it for the first time: for starts after the place before, as far back as the window reaches.
    """
    low = np.maximum(np.maximum(before[places] + 1, places - size + 1) - begin, 0)
    high = np.minimum(places - begin, n - 1)
    some = low <= high
    steps = np.bincount(low[some], minlength=n + 1) - np.bincount(high[some] + 1, minlength=n + 1)
    return np.cumsum(steps[:n])


def windows(text: bytes, held: dict[int, float], hopes: list[tuple[int, int, int]], sets: list[tuple[str, frozenset]], widths: list[list[int]], percent: int) -> Iterator[tuple[int, int, int, int]]:
    """(template, shared, sizes, line of the first word) of the best windows that don't overlap. held: coefficients of lines. Linear in the text for each hopeful template and width."""
    found = [(m.group(), m.start()) for m in WORD.finditer(text.lower())]
    numbers: dict[bytes, int] = {}
    word = np.fromiter((numbers.setdefault(w, len(numbers)) for w, _ in found), np.int64, len(found))
    breaks = np.array([m.start() for m in re.finditer(b"\n", text)], np.int64)
    line = np.searchsorted(breaks, np.array([a for _, a in found], np.int64))
    pair = word[:-1] * len(numbers) + word[1:]
    order = np.argsort(pair, kind="stable")
    same = pair[order[1:]] == pair[order[:-1]]
    before = np.full(len(pair), -1, np.int64)
    before[order[1:][same]] = order[:-1][same]
    bar = np.zeros(len(word) + 1)  # the coefficient of each word's line, if it holds a licence by itself
    if held:
        lines, values = (np.array(x) for x in zip(*sorted(held.items())))
        at = np.minimum(np.searchsorted(lines, line), len(lines) - 1)
        bar[:-1] = np.where(lines[at] == line, values[at], 0)
    inner = np.concatenate(([False], line[1:] == line[:-1], [False]))  # the word is on the line of the one before
    reached = []
    for i, first, last in hopes:
        other = sets[i][1]
        known = np.array([numbers[a] * len(numbers) + numbers[b] for a, b in other if a in numbers and b in numbers], np.int64)
        area = np.arange(max(0, first - widths[i][-1]), min(len(pair), last + widths[i][-1]))
        own = area[np.isin(pair[area], known)]
        for width in widths[i]:
            begin, n = int(area[0]), len(area) - width + 2
            if n < 1:
                continue
            shared = distinct_in_windows(before, own, begin, n, width - 1)
            both = distinct_in_windows(before, area, begin, n, width - 1) + len(other)
            start = np.flatnonzero(200 * shared >= percent * both)
            if not len(start):
                continue
            shared, both, start = shared[start], both[start], start + begin
            stop = start + width
            least = np.maximum.reduceat(bar, np.column_stack((start, stop)).ravel())[::2] if held else np.zeros(len(start))
            cuts = (bar[start] > 0) & inner[start] | (bar[stop - 1] > 0) & inner[stop]
            good = (2 * shared / both > least) & ((least == 0) | (line[start] < line[stop - 1]) & ~cuts)
            reached.append(np.column_stack((start, stop, np.full(len(start), i), shared, both))[good])
    if not reached:
        return
    start, stop, template, shared, both = np.concatenate(reached).T
    free = bytearray(len(word))
    for k in np.lexsort((stop, start, template, -shared / both)).tolist():
        a, z = int(start[k]), int(stop[k])
        if free.find(1, a, z) < 0:
            free[a:z] = b"\x01" * (z - a)
            yield int(template[k]), int(shared[k]), int(both[k]), int(line[a])


def scan(docs: DataFrame, percent: int = 80, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license (null: none), dice, line (from 0, of a window that of its first word; -1: the whole text) of the best unit, and n_units that hold a licence, for each row."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kinds = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("dice", pa.float64()), ("line", pa.int64()), ("n_units", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [(name, bigrams(text.encode())) for name, text in templates]
        pairs = sorted({p for _, s in sets for p in s})
        buffer = np.frombuffer(b" ".join(w for p in pairs for w in p), np.uint8)
        blank = np.flatnonzero(buffer == 32)
        hashes = span_hashes(buffer, np.concatenate(([0], blank + 1)), np.concatenate((blank, [len(buffer)])))
        mixed = hashes[::2] * np.uint64(0x9E3779B97F4A7C15) + hashes[1::2]
        known = np.unique(mixed)
        owns = np.array([np.isin(known, mixed[[p in s for p in pairs]]) for _, s in sets])
        widths = [widths_of(text, percent) for _, text in templates]
        needs = [max(1, -(-percent * len(s) // (200 - percent))) for _, s in sets]
        least, largest = (f(len(s) for _, s in sets) for f in (min, max))
        for part, texts in pieces_of(batches):
            found: list[list[tuple]] = [[] for _ in texts]
            hopes, whole, bits = hopeful(texts, known, percent, least, largest)
            for t, group in groupby(zip(*(x.tolist() for x in hopes)), lambda x: x[0]):
                lines = texts[t].split(b"\n")
                for _, line in group:
                    if hit := best_template(bigrams(lines[line]), sets, percent):
                        found[t].append((*hit, line))
            held = [{line: 2 * shared / both for _, shared, both, line in f} for f in found]
            taken = [(t, line) for t, h in enumerate(held) for line, dice in h.items() if dice == 1]
            for t, hopes in hopeful_windows(bits, taken, owns, [w[-1] for w in widths], needs).items():
                found[t].extend(windows(texts[t], held[t], hopes, sets, widths, percent))
            for t in whole.tolist():
                if b"\n" in texts[t] and (hit := best_template(bigrams(texts[t]), sets, percent)):
                    found[t].append((*hit, -1))
            best = [min(f, key=lambda x: (-x[1] / x[2], x[0], x[3])) if f else None for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([b and sets[b[0]][0] for b in best], pa.string()),
                    pa.array([b and 2 * b[1] / b[2] for b in best], pa.float64()),
                    pa.array([b and b[3] for b in best], pa.int64()),
                    pa.array([len(f) for f in found], pa.int32()),
                ],
                schema=kinds,
            )

    return in_arrow(rows, work, "doc_id long, license string, dice double, line long, n_units int")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best licence notice of every document, at a Dice coefficient of 0.8 or more."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
