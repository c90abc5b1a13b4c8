"""The operators on training data against plain versions, and on odd rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import bisect
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from segmentry.llm import chat, decontam, langid, licenses, minhash, packing, quality, shared, tokencounts, tokenfiles, topk
from segmentry.llm.oracles import SQL
from segmentry.llm.registry import QUERIES
from segmentry.llm.shared import new_path, shingles
from segmentry.llm.wordbpe import encoder

from tests.test_oracle import TABLES, canon

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, sid string, key int, w string, kept boolean, length int, sequence_id int"
LONG = " ".join(f"w{i % 997}" for i in range(60_000))
BIG = "<|im_end|>\\ é " * 150_000
ODD = [None, "", " \t\n", "one", "one two", "one two", "ÉTÉ déjà\n\nvu", "x" * 150_000, LONG, LONG + " end", "\n\n", "<|endoftext|> <|im_end|>", "日本語 テキスト", "a\x00b\x1cc\x85d"]


def documents(spark, texts, ids=None, langs=None):
    ids = ids or [*range(len(texts))]
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, "s", 0, 7, "a", 1, "b", True, 3, 4) for i, t, g in zip(ids, texts, langs)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, [*ODD, "no id", "again", "again"], [*range(len(ODD)), None, 99, 99]).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, ["x"]).limit(0)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(SQL[name])
    assert canon(got.columns, got.collect()) == canon(want.columns, want.fetchall())


# 1 token counts


def plain_allocation(sizes, ids, bounds, rule):
    """Tokens of each (start, end) in bytes, token by token."""
    at, want = 0, [0] * len(bounds)
    for t in ids:
        n = int(sizes[t])
        near = range(max(0, bisect.bisect_right([b for _, b in bounds], at) - 1), len(bounds)) if len(bounds) < 50 else range(bisect.bisect_right(ENDS, at), min(len(bounds), bisect.bisect_right(ENDS, at) + n + 1))
        held = {k: min(at + n, bounds[k][1]) - max(at, bounds[k][0]) for k in near}
        hit = [k for k, h in held.items() if h > 0]
        if hit:
            want[{"first": hit[0], "last": hit[-1], "majority": max(hit, key=lambda k: (held[k], -k))}[rule]] += 1
        at += n
    return want


def test_token_counts_add_up(spark, odd):
    global ENDS
    encoding, sizes = tokencounts.byte_encoder("byte_bpe_50k.tiktoken")
    for rule in tokencounts.RULES:
        rows = tokencounts.count_tokens(odd, rule).collect()
        for i, text in enumerate(ODD):
            own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.section)
            ids = encoding.encode_ordinary(text or "")
            assert sum(r.n_tokens for r in own) == len(ids)
            assert own[0].start == 0 and own[-1].end == len(text or "") and all(a.end == b.start for a, b in zip(own, own[1:]))
            bounds = [tuple(len((text or "")[:x].encode()) for x in (r.start, r.end)) for r in own]
            ENDS = [b for _, b in bounds]
            assert [r.n_tokens for r in own] == plain_allocation(sizes, ids, bounds, rule)


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_token_counts_of_named_sections(spark, rule):
    rng = random.Random(9)
    texts = ["".join(rng.choices(["the ", "é", "日本", "token", "\n\n", "  ", "x1 ", "😀"], k=rng.randrange(60))) for _ in range(40)]
    spans = [[(rng.choice(["title", "body", None]), rng.choice([None, rng.randrange(-3, 70)]) if rng.random() < 0.2 else rng.randrange(70), rng.randrange(90)) for _ in range(rng.randrange(6))] for _ in texts]
    rows = spark.createDataFrame(list(zip(range(40), texts, spans)) + [(40, None, [("a", 0, 3)]), (41, "abc", None)], "doc_id long, text string, parts array<struct<name: string, start: int, end: int>>")
    got = tokencounts.count_tokens(rows, rule, sections="parts").collect()
    encoding, sizes = tokencounts.byte_encoder("byte_bpe_50k.tiktoken")
    for i, (text, own) in enumerate(zip(texts, spans)):
        named, at = [], 0
        for name, a, b in sorted((s for s in own if s[1] is not None), key=lambda s: (s[1], s[2], s[0] is not None, s[0] or "")):
            a = min(max(a, at), len(text))
            b = min(max(a, b), len(text))
            named.append((name, a, b))
            at = max(at, b)
        want = plain_allocation(sizes, encoding.encode_ordinary(text), [(len(text[:a].encode()), len(text[:b].encode())) for _, a, b in named], rule)
        assert [(r.name, r.start, r.end, r.n_tokens) for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)] == [(*x, n) for x, n in zip(named, want)]
    assert [(r.start, r.end, r.n_tokens) for r in got if r.doc_id == 40] == [(0, 0, 0)] and not [r for r in got if r.doc_id == 41]


def test_long_white_space_has_the_ids_of_the_whole_text(spark):
    encoding, _ = tokencounts.byte_encoder("byte_bpe_50k.tiktoken")
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice([" ", "\n", "\t", "\u3000", "\x1c", "a", "é.", "'s ", "12"]) * rng.randrange(9) for _ in range(rng.randrange(12)))
        assert tokencounts.encoded(encoding, text, 3).tolist() == encoding.encode_ordinary(text), repr(text)
    for blank in (" ", "\n", " \n"):
        rows = tokencounts.count_tokens(documents(spark, ["a" + blank * (3_000_000 // len(blank)) + "b c"])).agg(F.sum("n_tokens").alias("n"), F.max("end").alias("end")).first()
        own = encoding._encode_single_piece((blank * (3_000_000 // len(blank)))[:-1].encode())
        assert rows.end == 3_000_004 and rows.n == 1 + len(own) + len(encoding.encode_ordinary(blank[-1] + "b c"))


def test_token_counts_empty(empty):
    assert tokencounts.count_tokens(empty).count() == 0


# 2 licences


def plain_units(text):
    """All units of a text that hold a licence, by trying every line, window and the whole text: (template, dice, line)."""
    sets = [(t, licenses.bigrams(t.encode())) for _, t in licenses.TEMPLATES]
    dice = lambda unit, other: 2 * len(unit & other) / max(1, len(unit) + len(other))
    lines, found, held = text.split("\n"), [], {}
    for x, unit in [*enumerate(lines), *([(-1, text)] if len(lines) > 1 else [])]:
        d, i = max((dice(licenses.bigrams(unit.encode()), s), -i) for i, (_, s) in enumerate(sets))
        if d >= 0.8:
            found.append((-i, d, x))
            held |= {x: d} if x >= 0 else {}
    words = [(w, x) for x, unit in enumerate(lines) for w in licenses.WORD.findall(unit.lower().encode())]
    tried = []
    for i, (t, s) in enumerate(sets):
        for width in licenses.widths_of(t, 80):
            for a in range(len(words) - width + 1):
                z, part = a + width, [w for w, _ in words[a : a + width]]
                d = dice(frozenset(zip(part, part[1:])), s)
                if d < 0.8:
                    continue
                first, last = words[a][1], words[z - 1][1]
                bar = max(held.get(x, 0) for _, x in words[a:z])
                cut = (first in held and a and words[a - 1][1] == first) or (last in held and z < len(words) and words[z][1] == last)
                if d > bar and (not bar or (first < last and not cut)):
                    tried.append((-d, i, a, z))
    used = []
    for d, i, a, z in sorted(tried):
        if all(z <= x or y <= a for x, y in used):
            used.append((a, z))
            found.append((i, -d, words[a][1]))
    return found


def test_licences_match_brute_force(spark):
    rng = random.Random(3)
    notices = [t for _, t in licenses.TEMPLATES[:17]]
    texts = []
    for n in range(80):
        parts = [rng.choices(["the", "of", "work", "License", "free", "under", "MIT"], k=rng.randrange(30)) for _ in range(3)]
        for _ in range(rng.choice([1, 1, 2])):
            words = rng.choice(notices).split()
            for _ in range(rng.randrange(1 + len(words) // 6)):
                at, how = rng.randrange(len(words)), rng.randrange(3)
                words[at : at + (how < 2)] = [] if how == 0 else [rng.choice(["the", "License", "of", "x"])]
            parts.append(words)
        rng.shuffle(parts)
        if n % 2:  # wrapped anew, over the edges of notices
            flat, wide = [w for p in parts for w in p], rng.randrange(3, 14)
            parts = [flat[i : i + wide] for i in range(0, len(flat), wide)]
        texts.append("\n".join(map(" ".join, parts)))
    got = {r.doc_id: r for r in licenses.scan(documents(spark, texts)).collect()}
    holding = 0
    for i, text in enumerate(texts):
        want = plain_units(text)
        holding += bool(want)
        best = min(want, key=lambda u: (-u[1], u[0], u[2]), default=None)
        assert got[i].n_units == len(want)
        assert (got[i].license, got[i].dice, got[i].line) == ((licenses.TEMPLATES[best[0]][0], pytest.approx(best[1]), best[2]) if best else (None, None, None))
    assert holding > 60


def test_licences_with_words_put_in_or_left_out(spark):
    rng = random.Random(8)
    fill = " ".join(["boats and rivers stand here"] * 12)
    texts, reach = [], []
    for name, t in licenses.TEMPLATES * 6:
        words = t.split()
        if len(words) < 20:
            continue
        for _ in range(len(words) // 8):
            at = rng.randrange(1, len(words) - 1)
            words[at:at] = ["thing"]
        bigrams, own = licenses.bigrams(" ".join(words).encode()), licenses.bigrams(t.encode())
        reach.append(2 * len(bigrams & own) >= 0.8 * (len(bigrams) + len(own)))
        texts.append(f"{fill} {' '.join(words)} {fill}")
    found = [r.n_units > 0 for r in licenses.scan(documents(spark, texts)).orderBy("doc_id").collect()]
    due = [f for f, r in zip(found, reach) if r]
    assert len(due) > 20 and sum(due) >= 0.9 * len(due)


def test_many_notices_in_one_text_take_linear_time(spark):
    def seconds(n, between):
        text = between.join(f"file {i} {licenses.TEMPLATES[5 + i % 4][1]} here" for i in range(n))
        docs = documents(spark, [text])
        begun = time.perf_counter()
        assert licenses.scan(docs).first().n_units == n
        return time.perf_counter() - begun

    for between in (" ", "\n"):
        seconds(100, between)
        assert seconds(16_000, between) < 12  # some 1 MB


def test_licences_over_lines_and_odd_rows(spark, odd, empty):
    words = licenses.TEMPLATES[4][1].split()
    wrapped = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    assert [tuple(r)[1:4] for r in licenses.scan(documents(spark, [wrapped])).collect()] == [("mit", 1.0, -1)]
    rows = licenses.scan(odd).collect()
    assert len(rows) == odd.count() and all(r.license is None and r.n_units == 0 for r in rows)
    assert licenses.scan(empty).count() == 0


def test_licences_wrapped_inside_longer_texts(spark):
    fill = "\n".join("some prose about boats and rivers stands here" for _ in range(6))
    wrap = lambda text, n: "\n".join(" ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    texts = [f"{fill}\n{wrap(t, n)}\n{fill}" for _, t in licenses.TEMPLATES for n in (3, 7)]
    texts += [f"We made boats for years. {t} The rivers are long and wide." for _, t in licenses.TEMPLATES]
    names = [n for n, _ in licenses.TEMPLATES for _ in range(2)] + [n for n, _ in licenses.TEMPLATES]
    mit = licenses.TEMPLATES[4][1].replace("documentation files,", 'documentation files (the "Software"),')
    texts.append("MIT License\n\nCopyright (c) 2020 A. Person\n\n" + wrap(mit, 11) + "\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n" + fill)
    got = {r.doc_id: r for r in licenses.scan(documents(spark, texts)).collect()}
    assert [got[i].license for i in range(len(texts))] == [*names, "mit"]
    assert all(got[i].dice == 1 for i in range(2 * len(licenses.TEMPLATES)))
    headed = [f"{name} licence\n\nCopyright (c) 2021 Some Body\n\n{wrap(t, 12)}\n\n{fill}\n{fill}" for name, t in licenses.TEMPLATES[-3:]]
    assert [(r.license, r.dice) for r in licenses.scan(documents(spark, headed)).orderBy("doc_id").collect()] == [("mit", 1.0), ("isc", 1.0), ("bsd", 1.0)]
    long = [" ".join(f"w{i % 5000}" for i in range(200_000)) + "\n" + t + "\nend" for _, t in licenses.TEMPLATES[:2]]
    assert [(r.license, r.n_units) for r in licenses.scan(documents(spark, long)).collect()] == [("apache-2.0", 1)] * 2
    both = licenses.TEMPLATES[10][1] + "\n" + fill + "\n" + wrap(licenses.TEMPLATES[6][1], 9)
    row = licenses.scan(documents(spark, [both])).first()
    assert (row.n_units, row.dice) == (2, 1) and row.license == "gpl-3.0"


# 3 near duplicates


def plain_components(texts, width, percent):
    sets = [set(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else {tuple(w)} - {()} for w in ((t or "").encode().lower().split() for t in texts)]
    label = list(range(len(sets)))
    moved = True
    while moved:
        moved = False
        for i in range(len(sets)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    moved = True
    return [len(s) for s in sets], label


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    texts = []
    for k in range(90):  # a cloud of copies around one text, most not near each other, with copies of copies, and clean texts
        words = list(texts[-1].split() if k % 9 == 8 else base if k % 3 else [f"v{rng.randrange(4000)}" for _ in range(100)])
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
        texts.append(" ".join(words))
    texts += [texts[1], texts[1].upper(), None, "", "a b", "A  B", "a c"]
    sizes, labels = plain_components(texts, 3, 85)
    rows = minhash.near_duplicates(documents(spark, texts), words=3, percent=85, block=4).orderBy("doc_id").collect()
    assert [r.n_shingles for r in rows] == sizes
    assert [r.component_id for r in rows] == labels
    shared.HOT_ROWS, minhash.STAR, kept = 5, 3, (shared.HOT_ROWS, minhash.STAR)  # as if nearly every key were hot
    minhash.HOT_ROWS = 5
    try:
        hot = minhash.near_duplicates(documents(spark, texts), words=3, percent=85).orderBy("doc_id").collect()
    finally:
        (shared.HOT_ROWS, minhash.STAR), minhash.HOT_ROWS = kept, kept[0]
    assert hot == rows
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_odd_rows(odd, empty):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[5].component_id == 4 and by[9].component_id == 8 and by[0].kept and by[None].component_id is None and by[None].kept
    assert minhash.near_duplicates(empty).count() == 0


def test_links_of_very_large_sets_are_exact():
    both = 200_003  # beyond what a product of single precision holds
    for percent, n, want in ((80, 250_003, True), (80, 250_004, False)):
        a, b = np.arange(both, dtype=np.uint64), np.arange(n, dtype=np.uint64)
        assert minhash.linked_matrix([a], [b], percent).item() == want == minhash.is_link(both, len(a), len(b), percent)


def test_superfluous_rows(spark):
    rows = [(0, 3, "A b c d e f"), (1, 5, "A b c d e f"), (2, 5, "q r s t u v"), (3, None, "a b c d e f"), (4, None, "x y"), (5, None, "X  y"), (6, 9, None), (7, 9, None), (8, 1, "Q r s t u v")]
    got = minhash.superfluous(spark.createDataFrame(rows, "row long, doc_id long, text string"), "row").collect()
    assert sorted(r.key for r in got) == [1, 2, 3, 5]


def test_estimate_is_near_the_similarity(spark):
    rng = np.random.default_rng(0)
    for common in (200, 600, 900):
        a, b = rng.integers(0, 2**63, (2, 1000), dtype=np.uint64)
        b[:common] = a[:common]
        rows = spark.createDataFrame([tuple(minhash.packed(minhash.minima(np.unique(x))).tolist() for x in (a, b))], "sig_a array<long>, sig_b array<long>")
        got = rows.select(minhash.similarity_estimate("sig_a", "sig_b").alias("s")).first()["s"]
        assert abs(got - common / (2000 - common)) < 0.15


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"\xf0", b"\xf1")], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in minhash.components(edges).collect()}
    assert got == {bytes([i]): b"\x00" for i in range(41)} | {b"\xf0": b"\xf0", b"\xf1": b"\xf0"}


def test_shingle_hashes_are_the_words(spark):
    one, two, three = shingles([b"A b  c d", b"x\na B\tC", b"q"], 3)
    assert len(one) == 2 and len(two) == 2 and len(np.intersect1d(one, two)) == 1 and len(three) == 1
    assert len(set(map(int, np.concatenate(shingles([b"a b", b"b a", b"a", b"b", b"ab", b"a b a", b"", b"a a", b"a a a"], 3))))) == 8


def hostile(n):
    """Two different words whose sums of powers of any odd base agree modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_hostile_words_are_no_duplicates(spark):
    for size in (512, 4096):
        x, y = hostile(size)
        texts = [x, y, f"{x} {y}", f"{y} {x}", f"one {x} two three four", f"one {y} two three four", f"{x} p {y} q {x}", x, f"a b c {x} d {y} e", f"a b c {y} d {x} e"]
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, texts), words=3, percent=85).collect()}
        assert got == {i: (len(s := plain_shingles(t, 3)), next(j for j, u in enumerate(texts) if plain_shingles(u, 3) == s)) for i, t in enumerate(texts)}
    rows = documents(spark, [f"{x} b c d e f", f"{y} b c d e f", f"{x} b c d e f"])
    kept = corpus_pipeline.unique(spark, rows, "").collect()
    assert sorted(r.doc_id for r in kept) == [0, 1]


def plain_shingles(text, width):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


# 4 quality


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    model = quality.learn(docs, labels.where(~fold))
    some = labels.where(fold)
    rows = quality.classify(docs.join(some, "doc_id", "left_semi"), model).join(some, "doc_id").select("kept", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).collect()
    assert sum(r.kept == r.good for r in rows) / len(rows) > 0.95
    good = [r for r in rows if r.good]
    assert sum(r.kept for r in good) / len(good) > 0.98
    assert (np.diff(model.thresholds) >= 0).all()


def test_quality_fit_is_that_of_a_plain_one():
    """Against the penalised likelihood as it is written, climbed by numerical gradients."""
    rng = np.random.default_rng(4)
    held = rng.random((150, 5)) < 0.5
    position = held @ np.array([2.0, -2.0, 1.0, 0.5, 0.0]) + rng.logistic(size=150)
    grades = np.digitize(position, [-0.5, 1.5])

    def value(x):
        w, cuts = x[:5], np.concatenate(([-np.inf], x[5:], [np.inf]))
        at = 1 / (1 + np.exp(held @ w - cuts[:, None]))  # P(grade < k)
        return np.mean(np.log(at[grades + 1, np.arange(150)] - at[grades, np.arange(150)])) - quality.DECAY / 2 * (w**2).sum()

    x = np.array([0.0] * 5 + [-1.0, 1.0])
    for _ in range(4000):
        x = x + np.array([(value(x + e) - value(x - e)) / 2e-5 for e in np.eye(7) * 1e-5])
    rows, feature = np.nonzero(held)
    model = quality.fit(rows, feature, grades)
    got = np.concatenate((model.weights[:5], model.thresholds))
    assert value(got) > value(x) - 1e-4 and np.abs(got - x).max() < 0.05
    tails = quality._sigmoid(position[:3, None] - model.thresholds)
    assert (tails[:, 0] >= tails[:, 1]).all()


def test_quality_features_and_repeated_ids(spark):
    one, two, other = (set(quality.features([t])[1].tolist()) for t in (b"a!!?!!b", b"a!!?!!b", b"a!!?!#b"))
    assert one == two != other  # whole runs of symbols
    docs = documents(spark, ["good fine words", "bad !!!", "zzz"] * 40, [*range(100, 140), *range(100, 140), *range(100, 140)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100, 140)], "doc_id long, quality int, toxic int")
    models = [quality.learn(docs.repartition(n), labels) for n in (1, 7)]
    assert np.allclose(models[0].weights, models[1].weights, atol=1e-5)


def test_quality_order_and_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(8, 1, 0), (8, 0, 0), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for model in (quality.learn(odd, labels), quality.learn(odd, labels.limit(0)), quality.learn(empty, labels)):
        rows = quality.classify(odd, model).collect()
        assert len(rows) == odd.count() and all(r.kept and 0 <= r.p_best <= 1 and 0 <= r.expected_grade <= 2 for r in rows)
    assert quality.classify(empty, model).count() == 0


# 5 decontamination


def test_decontamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(0, "One, TWO!", 1), (1, None, 1), (2, "", 1), (3, " ".join(f"w{i}" for i in range(500, 530)), 1), (3, "w1 w2 w3 w4 w5 w6", 1), (None, "one", 1)], "item_id long, text string, n int")
    got = sorted((r.doc_id, -1 if r.item_id is None else r.item_id) for r in decontam.contaminated(odd, items).collect())
    assert got == [(3, -1), (4, -1), (4, 0), (5, -1), (5, 0), (8, 3), (8, 3), (9, 3), (9, 3)]
    shuffled = decontam.contaminated(odd, items, broadcast_rows=0).collect()
    assert sorted((r.doc_id, -1 if r.item_id is None else r.item_id) for r in shuffled) == got
    assert decontam.contaminated(empty, items).count() == 0 and decontam.contaminated(odd, items.limit(0)).count() == 0


@pytest.mark.parametrize("size", [6, 7, 15, 16, 31, 33, 80])
def test_minima_lose_no_item_at_the_threshold(spark, size):
    rng = random.Random(size)
    words = [f"u{i}" for i in range(size + 4)]
    n, texts = size, []
    for _ in range(12):  # cuts at the end lose one shingle each
        lost = n - -(-n * 80 // 100)
        texts.append(" ".join([f"z{rng.random()}" for _ in range(50)] + words[: len(words) - lost]))
        texts.append(" ".join(words[: len(words) - lost - 1]))
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.contaminated(documents(spark, texts), items).collect()) == [*range(0, 24, 2)]


# 6 language


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.995


def plain_language(texts, langs, held):
    """Shares of each text by trigram tables and EM, word by word."""
    def grams(text):
        padded, out = ["\n", *text.lower(), "\n"], []
        shown = [ord(c) if c.isalpha() else 0 for c in padded]
        for i, c in enumerate(padded):
            if c.isalpha():
                if not shown[i - 1]:
                    out.append([])
                x = (shown[i - 1] * 0x9E3779B1 & 0xFFFFFFFF) ^ ((shown[i] * 0x85EBCA77 & 0xFFFFFFFF) + (shown[i + 1] * 0xC2B2AE3D & 0xFFFFFFFF) & 0xFFFFFFFF)
                x ^= x >> 15
                out[-1].append((x * 0x2C1B3C6D & 0xFFFFFFFF) >> 17)
        return out

    names = sorted({g for g, h in zip(langs, held) if g and not h})
    counts = {g: Counter(b for t, l, h in zip(texts, langs, held) if l == g and t and not h for w in grams(t) for b in w) for g in names}
    sums = {g: sum(c.values()) + 0.5 * langid.BUCKETS for g, c in counts.items()}
    out = []
    for text in texts:
        words = [[math.exp(sum(math.log((counts[g][b] + 0.5) / sums[g]) for b in w) + 8 * len(w)) for g in names] for w in grams(text or "")]

        def em(subset):
            share, last = {k: 1 / len(subset) for k in subset}, -math.inf
            while True:
                total = [sum(w[k] * share[k] for k in subset) for w in words]
                score = sum(map(math.log, total))
                if score - last < 1e-9:
                    return share, score
                last = score
                share = {k: sum(w[k] * share[k] / t for w, t in zip(words, total)) / len(words) for k in subset}

        if not words:
            out.append({})
            continue
        order = sorted(range(len(names)), key=lambda k, s=em(range(len(names)))[0]: -s[k])
        best = None
        for m in range(1, len(names) + 1):
            share, score = em(order[:m])
            score -= 0.5 * (m - 1) * math.log(len(words))
            if best and score <= best[1]:
                break
            best = share, score
        out.append({names[k]: s for k, s in best[0].items()})
    return out


def test_language_matches_plain_em(spark, tmp_path):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if r.text and len(r.text) < 1500][:60]
    texts = [r.text for r in docs] + [docs[i].text[:300] + " " + docs[j].text[:300] for i in range(0, 60, 7) for j in range(3, 60, 11)] + [None, "", "12 3"]
    langs = [r.lang for r in docs] + [None] * (len(texts) - 60)
    ids = [*range(1000, 1000 + len(texts))]
    documents(spark, texts, ids, langs).write.parquet(f"{tmp_path}/documents.parquet")
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]
    want = plain_language(texts, langs, held)
    got = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, str(tmp_path)).collect()}
    for i, h, shares in zip(ids, held, want):
        assert got[i].held_out == h and got[i].score == pytest.approx(max(shares.values(), default=0), abs=0.02)
        assert got[i].lang_pred == max(shares, key=lambda g: (shares[g], g), default="und")
    assert sum(len(s) > 1 for s in want) > 10


def test_languages_are_bounded_and_many_are_followed():
    rng = np.random.default_rng(3)
    like, words = rng.random((400, 120)) ** 8, np.array([150, 1, 249])
    like[:150, 7] += 1
    like[150:, 30] += np.arange(250) % 2
    like[150:, 31] += 1 - np.arange(250) % 2
    shares = langid.mixtures(like, words)
    assert np.allclose(shares.sum(axis=1), 1) and shares[0].argmax() == 7 and shares[2, 30] > 0.4 and shares[2, 31] > 0.4


def test_mixtures_reach_the_best_fit_and_end_soon():
    """Many languages that are hard to tell apart: a long text alone, in blocks, and among others; equal words are one with a count."""
    rng = np.random.default_rng(8)
    like = np.exp(rng.normal(0, 0.3, (40_000, 24)))
    like[:, 5] *= 1.3
    words, times = np.array([40_000]), rng.integers(1, 4, 40_000).astype(float)
    full, score = langid.converged(like, words, times, np.array([times.sum()]), np.full((1, 24), 1 / 24))
    _, plain, left = langid.em_round(like, words, times, np.array([times.sum()]), full)
    slow = np.full((1, 24), 1 / 24)
    for _ in range(300):
        slow = langid.em_round(like, words, times, np.array([times.sum()]), slow)[0]
    best = langid.em_round(like, words, times, np.array([times.sum()]), slow)[1]
    assert score[0] == pytest.approx(plain[0]) and score[0] > best[0] - 0.1
    alone = langid.mixtures(like, words, times)
    among = langid.mixtures(np.concatenate((like, like[:50])), np.array([40_000, 50]), np.concatenate((times, times[:50])))
    assert np.allclose(alone[0], among[0], atol=1e-6)
    small, n = like[:60], np.arange(60) % 3 + 1
    repeated = langid.mixtures(np.repeat(small, n, axis=0), np.array([n.sum()]))
    assert np.allclose(langid.mixtures(small, np.array([60]), n.astype(float)), repeated, atol=1e-6)


def test_long_texts_of_many_close_languages():
    rng = np.random.default_rng(9)
    table = rng.normal(0, 0.02, (langid.BUCKETS, 64))
    model = langid.LanguageModel(tuple(f"l{i:02}" for i in range(64)), (table - np.log(np.exp(table).sum(axis=0))).astype(np.float32))
    letters, ends = rng.integers(97, 123, 900_000), np.sort(rng.choice(900_000, 150_000, replace=False))
    letters[ends] = 32
    text = "".join(map(chr, letters.tolist()))
    begun = time.perf_counter()
    shares = model.shares([text, "", text[:400], "12"])
    assert time.perf_counter() - begun < 30  # more than two minutes before rounds were speeded
    assert np.allclose(shares.sum(axis=1), [1, 0, 1, 0])
    assert np.allclose(shares[2], model.shares([text[:400]])[0], atol=1e-6)


def test_words_are_counted_by_text():
    assert langid.distinct_words(["ab cd\nab-ab", "", "1 2", "\u00e9t\u00e9 x"]) == [{"ab": 3, "cd": 1}, {}, {}, {"\u00e9t\u00e9": 1, "x": 1}]
    assert langid.distinct_words([""]) == [{}]


def test_most_frequent_languages_are_learned(spark):
    docs = documents(spark, ["ab cd"] * 9, langs=["x", "x", "x", "y", "y", "z", "w", "v", "u"])
    assert langid.learn(docs, most=3).languages == ("u", "x", "y")


def test_language_mixture_and_odd_rows(spark, odd, empty):
    texts = ["the cat and the dog were in the house with them"] * 5 + ["der hund und die katze sind nicht in dem haus"] * 5
    model = langid.learn(documents(spark, texts, langs=["en"] * 5 + ["de"] * 5))
    mixed = model.shares([texts[0] + " " + texts[9] * 1, texts[0] * 3, "1234", ""])
    assert mixed[0].min() > 0.2 and mixed[1].max() == 1 and not mixed[2:].any()
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert len(rows) == odd.select("doc_id").distinct().count()
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (0, 1, 2, 10)) and rows[3].lang_pred in ("en", "de")
    assert langid.identify(empty, model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.learn(empty)).collect()} == {"und"}


def test_language_stage_rejects_what_was_not_learned(spark):
    import corpus_pipeline

    rng = random.Random(4)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(60)),
    ]
    rows = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(planted)], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(rows, allowMissingColumns=True), SF).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}


# 7 and 8 tokens


def test_word_encoder_is_the_tokenizer():
    enc, rng = encoder("word_bpe_49k.json"), random.Random(1)
    parts = [*"abzAZéÉßİıÀ'sdtm12 ½²٣́­\x1c\x1d\x85\xa0 \t\n.,!?日Σς가\x00\x7f", "<|endoftext|>", "'s", "'LL", "the", ".,", " "]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randrange(14)))
        assert enc.encode(text.encode()).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def expected_ids(texts):
    tokenizer = encoder("word_bpe_49k.json").tokenizer
    return [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in texts]


def test_token_files_round_trip(spark, odd, empty):
    rows = sorted([(d.doc_id is not None, d.doc_id or 0, d.h, d.text) for d in odd.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()])
    want, start = [], 0
    for (known, i, _, _), ids in zip(rows, expected_ids([r[3] for r in rows])):
        want.append((i if known else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    folder = new_path(spark, "tokens")
    files = tokenfiles.write_token_files(odd, folder)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in tokenfiles.read_token_files(spark, folder, files).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    there = Path(folder.removeprefix("file://"))
    (there / "precious.txt").write_text("kept")
    again = tokenfiles.write_token_files(odd, folder)  # the first run's files and what else is there stay
    assert {p.name for p in there.iterdir()} == {"precious.txt"} | {r.file for r in files.union(again).collect()}
    run = again.first()["file"].rsplit("-", 2)[0]
    (there / f"{run}-000000-lost.zst").write_text("of an attempt that failed")
    tokenfiles._remove_attempts(folder, run, {r.file for r in again.collect()})
    assert {p.name for p in there.iterdir()} == {"precious.txt"} | {r.file for r in files.union(again).collect()}
    assert tokenfiles.read_token_files(spark, folder, files).count() == len(want)
    repeated = spark.range(3000).selectExpr("cast(null as long) doc_id", "'the same text' text").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    many = tokenfiles.write_token_files(repeated, new_path(spark, "tokens")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.documents for r in many) == 3000 and max(r.documents for r in many) < 1500
    assert tokenfiles.read_token_files(spark, "file:///none", tokenfiles.write_token_files(empty, new_path(spark, "tokens"))).count() == 0


def test_token_file_of_many_small_frames_reads_in_linear_time(monkeypatch):
    import io
    import time

    monkeypatch.setattr(tokenfiles, "FRAME_BYTES", 8)
    out = io.BytesIO()
    writer = tokenfiles.TokenFileWriter(out, 2)
    for i in range(80_000):
        writer.add(i, np.array([i % 1000, 1], np.uint32))
    writer.close()
    file = tokenfiles.TokenFile(out, out.tell())
    began = time.process_time()
    assert len(file.frames) == 40_000 and [int(ids[0]) for _, ids in file.documents()] == [i % 1000 for i in range(80_000)]
    assert time.process_time() - began < 4
    assert [(p, ids.tolist()) for p, ids in file.documents([5, 79_999, 4])] == [(4, [4, 1]), (5, [5, 1]), (79_999, [999, 1])]


def test_token_file_reads_only_the_frames_asked_for():
    import io

    import zstandard

    out, docs = io.BytesIO(), [np.arange(k % 7 + 1) + k for k in range(200)]
    writer = tokenfiles.TokenFileWriter(out, 2)
    tokenfiles.FRAME_BYTES, kept = 64, tokenfiles.FRAME_BYTES
    for k, ids in enumerate(docs):
        writer.add(k, ids)
    writer.close()
    tokenfiles.FRAME_BYTES = kept
    raw = out.getvalue()
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert np.frombuffer(whole, "<u2").tolist() == np.concatenate(docs).tolist()
    file, seen = tokenfiles.TokenFile(io.BytesIO(raw), len(raw)), []
    frame, file.frame = file.frame, lambda k: seen.append(k) or frame(k)
    assert [ids.tolist() for _, ids in file.documents([3, 150])] == [docs[3].tolist(), docs[150].tolist()] and len(seen) == 2 < len(file.frames)
    broken = bytearray(raw)
    broken[int(file.starts[1]) + 12] ^= 1
    with pytest.raises(Exception):
        list(tokenfiles.TokenFile(io.BytesIO(bytes(broken)), len(raw)).documents())


def test_plans_hold_every_piece():
    rng = np.random.default_rng(0)
    for capacity, n in ((30, 200), (100, 77), (4096, 5000), (7, 50), (4096, 1)):
        lengths = np.clip(rng.lognormal(np.log(capacity / 5), 0.9, n).astype(int), 1, capacity)
        histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
        plan, held = packing.make_plan(histogram, capacity), {}
        for pattern, times in plan:
            assert 0 < sum(pattern) <= capacity and times > 0
            for x in pattern:
                held[x] = held.get(x, 0) + times
        assert held == histogram
        assert sum(t for _, t in plan) <= max(-(-int(lengths.sum()) // capacity), int((lengths > capacity / 2).sum())) * 1.05 + 1


def least_bins(lengths, capacity):
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for room in {b for b in bins if b >= lengths[i]}:
            rest = [*bins]
            rest.remove(room)
            place(i + 1, [*rest, room - lengths[i]])
        place(i + 1, [*bins, capacity - lengths[i]])

    place(0, [])
    return best


def test_reduction_loses_nothing():
    rng = random.Random(4)
    for _ in range(60):
        lengths = sorted((rng.randrange(1, 21) for _ in range(8)), reverse=True)
        counts = np.bincount(lengths, minlength=21)
        fixed = packing.reduce_instance(counts, 20)
        left = [x for x in range(20, 0, -1) for _ in range(counts[x])]
        assert sum(t for _, t in fixed) + least_bins(left, 20) == least_bins(lengths, 20)


def test_reduction_fixes_sets_of_three():
    counts = np.bincount([10, 6, 3, 7, 7], minlength=21)  # 10 + 6 + 3 fills most, and 7 + 3 fits as well
    assert packing.dominating(np.bincount([6, 3, 5], minlength=21), 10, 20) == (10, 6, 3)
    assert packing.dominating(counts - np.bincount([10], minlength=21), 10, 20) == (10, 7, 3)
    rng, triples = random.Random(8), 0
    for _ in range(300):
        lengths = sorted((rng.randrange(4, 21) for _ in range(8)), reverse=True)
        counts = np.bincount(lengths, minlength=21)
        fixed = packing.reduce_instance(counts, 20)
        triples += any(len(p) == 3 and sum(p) < 20 for p, _ in fixed)
        left = [x for x in range(20, 0, -1) for _ in range(counts[x])]
        assert sum(t for _, t in fixed) + least_bins(left, 20) == least_bins(lengths, 20)
    assert triples > 10


def test_packed_sequences_hold_the_ids(spark, odd):
    pieces = packing.token_pieces(odd, 512)
    whole = packing.sequences(packing.assign(pieces, 512)).collect()
    assert sum(len(r.ids) // 4 for r in whole) == sum(r.length for r in pieces.collect()) and all(sum(r.lengths) * 4 == len(r.ids) <= 2048 for r in whole)
    cut_up = sorted(bytes(r.ids[4 * a : 4 * (a + n)]) for r in whole for a, n in zip(np.cumsum([0, *r.lengths]).tolist(), r.lengths))
    assert cut_up == sorted(bytes(r.ids) for r in pieces.collect())


def test_packing_odd_rows(spark, odd, empty):
    rows = packing.pack_documents(odd, 512).collect()
    texts = odd.select("doc_id", "text").collect()
    want = sorted(((d.doc_id is None, d.doc_id or 0, k, a, min(512, len(ids) - a), zlib.crc32(ids[a : a + 512].tobytes())) for d, ids in zip(texts, expected_ids([d.text for d in texts])) for k, a in enumerate(range(0, len(ids), 512))))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 512
    assert packing.pack_documents(empty).count() == 0


# 9 chat


def test_chat_is_reversible(spark):
    rng, template = random.Random(2), chat.Template()
    parts = ["<|im_start|>", "<|im_end|>\n", "\\", "\\l", "<", "l", "\n", "assistant", "é"]
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "a\nb", "\\n", "<x>", ""]), "".join(rng.choices(parts, k=rng.randrange(6)))) for _ in range(rng.randrange(5))]
        assert list(template.parse("".join(s for role, text in turns for s, _ in template.turn(role, text)))) == turns


def test_chat_odd_rows(spark):
    rows = [(1, 1, "assistant", None, 9), (1, 0, "user", chat.HOSTILE, 9), (2, 0, "assistant", "x", 9), (None, None, None, None, 9), (None, 0, "user", "hi", 9), (None, 0, "user", "hi", 9), (5, 0, "user", "q", 9), (5, 1, "assistant", BIG, 9), (5, 2, "assistant", "x", 9), (3, 0, "user", "a", 9), (3, 0, "user", "a", 9), (4, None, "system", "s", 9), (4, 0, "user", "q", 9), (4, 1, "assistant", "r<", 9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")
    every = chat.read_back(chat.format_segments(turns)).collect()
    got = {r.conv_id: r for r in every}
    digest = lambda pairs: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in pairs).encode()).hexdigest()
    assert got[1].turns_sha256 == digest([("user", chat.HOSTILE), ("assistant", "")]) and got[1].loss_chars == 0
    assert (got[4].n_turns, got[4].loss_chars, got[4].bad_turn, got[2].bad_turn, got[3].bad_turn, got[3].n_turns) == (3, 2, None, 0, 1, 2)
    assert got[4].loss_sha256 == hashlib.sha256(b"r<").hexdigest()
    alone = sorted((r.n_turns, r.turns_sha256, r.loss_chars, r.bad_turn) for r in every if r.conv_id is None)
    assert alone == sorted([(1, digest([("", "")]), 0, 0), (1, digest([("user", "hi")]), 0, None), (1, digest([("user", "hi")]), 0, None)])
    assert got[5].turns_sha256 == digest([("user", "q"), ("assistant", BIG), ("assistant", "x")]) and (got[5].loss_chars, got[5].bad_turn) == (len(BIG) + 1, 2)
    assert chat.read_back(chat.format_segments(turns.limit(0))).count() == 0


# 10 top-k


def test_topk_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=40).tolist(), 1, 2) for i in range(120)] + [(200 + i, [0.5] * 40, 1, 2) for i in range(30)]
    rows += [(300, None, 1, 2), (301, [1.0, None], 1, 2), (302, [float("nan")] * 40, 1, 2), (303, [float("inf")] * 40, 1, 2), (304, [], 1, 2), (305, [1.0], 1, 2), (None, [1.0] * 40, 1, 2), (7, [9.0] * 40, 1, 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, v int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(table, F.col("id") % 50 == 0, 5).collect())
    good = [(i, np.floor(256 * np.pad(np.array(v, np.float32).astype(float), (0, 40 - len(v)))).astype(int)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q % 50 == 0:
            best = sorted((-int(a @ b), i) for i, b in good if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(table.limit(0), F.col("id") % 50 == 0).count() == 0
    blocks = topk.top_k(table, F.col("id") % 50 == 0, 5, block=8, query_block=2)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in blocks.collect()) == got


def test_topk_repeated_rows(spark):
    rows = spark.range(400).selectExpr("cast(1 as long) vec_id", "array(1F, 2F) embedding").unionByName(spark.createDataFrame([(0, [1.0, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>"))
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk.top_k(rows, F.col("id") == 0, 3, block=8).collect())
    assert got == [(k, 1, 768 * 256) for k in (1, 2, 3)]


def test_topk_large_values():
    rng = np.random.default_rng(3)
    x, q = rng.integers(-(2**27), 2**27, (200, 33)), rng.integers(-(2**27), 2**27, (3, 33))
    got = list(topk.search(np.arange(200), x, np.array([-1, -2, -3]), q, 4))
    want = [(-1 - k, i, s) for k, row in enumerate(q) for s, i in sorted(((int(row @ v), i) for i, v in enumerate(x)), key=lambda p: (-p[0], p[1]))[:4]]
    assert got == want


# Batches


def test_batches_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for given, want in (("10000", shared.BATCH_ROWS), ("0", shared.BATCH_ROWS), ("7", 7)):
        spark.conf.set(name, given)
        shared.bound_batches(spark)
        assert int(spark.conf.get(name)) == want
    texts = spark.range(50).selectExpr("id", "cast(id as string) text").coalesce(1)
    sizes = shared.in_arrow(texts, lambda batches: (b.slice(0, 1).select(["id"]) for b in batches), "id long")
    assert [r.id for r in sizes.collect()] == list(range(0, 50, 7))
    assert shared.filtered(texts, lambda raw: np.array([t == b"8" for t in raw])).count() == 1
    spark.conf.unset(name)


# The pipeline


def prose(rng, n):
    """Words of the learned kind in an order of their own."""
    return " ".join(rng.choices("the river was long and many boats went down to sea with old men who told stories about winter storms".split(), k=n))


def test_pipeline_stages(spark, empty):
    rng = random.Random(12)
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"extra": F.lit("x"), "_row": F.lit("y"), "key": F.lit("z"), "id": F.lit(1)})
    long = prose(rng, 250_000)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").orderBy(F.desc(F.length("text"))).first()["text"]
    one, two = prose(rng, 90), prose(rng, 80)
    odd_rows = [(10_000, None), (10_001, ""), (10_002, "12 34"), (10_003, one), (10_005, one), (10_005, two), (None, two), (None, two), (None, prose(rng, 70)), (10_006, long), (10_007, long + " end"), (10_008, prose(rng, 400) + " " + item)]
    columns = docs.columns
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame(odd_rows, "doc_id long, text string"), allowMissingColumns=True)
    language, good, unique, clean, packed = (f for _, f in corpus_pipeline.STAGES)
    first = language(spark, docs, SF).cache()
    assert first.columns == columns and first.count() == docs.count() - 3
    second = good(spark, first, SF).cache()
    model = quality.learn(first, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = first.collect()
    assert second.columns == columns and Counter(second.collect()) == Counter(r for r, k in zip(rows, model.tails([r.text.encode() for r in rows])[:, -1] >= 0.5) if k)
    third = unique(spark, second, SF).cache()
    rows = sorted(second.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    _, labels = plain_components([r.text for r in rows], 5, 80)
    kept = third.collect()
    assert third.columns == columns and len(kept) == len(set(labels))
    by_text = {r.text: label for r, label in zip(rows, labels)}
    assert sorted((by_text[r.text], r.doc_id is None, r.doc_id or 0) for r in kept) == [(label, rows[label].doc_id is None, rows[label].doc_id or 0) for label in sorted(set(labels))]
    fourth = clean(spark, third, SF).cache()
    items = [re.findall(r"[^\W_]+", (r.text or "").lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sets = [{tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)} for w in items if w]

    def leaks(text):
        w = re.findall(r"[^\W_]+", text.lower())
        own = {k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for k in {len(next(iter(s))) for s in sets}}
        return any(len(s & own[len(next(iter(s)))]) * 100 >= 80 * len(s) for s in sets)

    assert fourth.columns == columns and Counter(fourth.collect()) == Counter(r for r in kept if not leaks(r.text))
    assert leaks(odd_rows[-1][1]) and not [r for r in fourth.collect() if r.doc_id == 10_008]
    last = packed(spark, fourth, SF).collect()
    texts = fourth.collect()
    want = Counter((r.doc_id, k, min(4096, len(ids) - at), zlib.crc32(ids[at : at + 4096].tobytes())) for r, ids in zip(texts, expected_ids([r.text for r in texts])) for k, at in enumerate(range(0, len(ids), 4096)))
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in last) == want
    held = Counter()
    for r in last:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 4096 and len(held) <= -(-sum(held.values()) // 4096) * 1.05 + 1
    assert packed(spark, clean(spark, unique(spark, good(spark, language(spark, empty, SF), SF), SF), SF), SF).count() == 0


def test_pipeline_run_leaves_only_its_result(spark):
    before = set(Path(shared.shared_dir(spark).removeprefix("file://")).iterdir())
    rows = corpus_pipeline.run(spark, SF)
    left = {p.name.split("-")[0] for p in set(Path(shared.shared_dir(spark).removeprefix("file://")).iterdir()) - before}
    assert left == {"packing"}
    assert rows.count() > 100
