"""Hard negatives, near duplicates of vectors and collocations against plain versions, and on odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from segmentry.llm import collocations, negatives, vectordups

VECTORS = "vec_id long, embedding array<double>, label int, id long, score long, copies long, no long, bucket int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, 1, 2, 3, 4, 5) for i, v, k in rows], VECTORS)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_negatives(rows):
    rows = [(i, k, [math.floor(256 * x) for x in v]) for i, v, k in rows if i is not None and k is not None and usable(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for anchor in {i for i, _, _ in rows if i % 50 == 0}:
        _, label, vec = max((r for r in rows if r[0] == anchor), key=lambda r: (r[1], r[2]))
        scored = sorted((-dot(vec, v), i, k) for i, k, v in rows if i != anchor)
        for p, i, k in [x for x in scored if x[2] == label][:5]:
            window = [(s, j) for s, j, o in scored if o != label and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(anchor, i, rank, j, -p, -s) for rank, (s, j) in enumerate(window[:3], 1)]
    return sorted(out)


def mined(spark, rows, **how):
    return sorted(map(tuple, negatives.mine_negatives(table(spark, rows), F.col("id") % 50 == 0, F.col("label"), **how).collect()))


ODD_VECTORS = [
    (None, [0.5, 0.5, 0.5], 1), (0, None, 1), (50, [None, 0.5, 0.1], 1), (100, [math.nan, 0.5, 0.1], 1), (150, [math.inf, 0.1, 0.1], 1), (200, [0.5, 0.5, 0.5], None), (250, [], 1), (300, [0.0, 0.0, 0.0], 1),
    (350, [0.25, 0.5], 1), (351, [0.25, 0.5], 1), (351, [0.25, 0.5], 1), (352, [0.25, 0.4], 2), (353, [0.25, 0.4], 2), (353, [0.25, 0.4], 2), (350, [0.1, 0.2], 1), (354, [-0.5, -0.5], 1), (355, [0.1, 0.3, 0.5], 2),
]


@pytest.mark.parametrize("blocks", [(16_384, 2_048), (37, 3)])
def test_hard_negatives_match_brute_force(spark, blocks):
    rng = np.random.default_rng(1)
    rows = [(i, np.round(rng.normal(0.2, 0.4, 6), 2).tolist(), int(rng.integers(0, 3))) for i in range(400)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(40)] + [(2000 + i, rows[50][1], 2) for i in range(30)]  # ties
    assert mined(spark, rows, block=blocks[0], anchor_block=blocks[1]) == plain_negatives(rows)


def test_hard_negatives_odd_rows(spark):
    assert mined(spark, ODD_VECTORS) == plain_negatives(ODD_VECTORS)
    assert mined(spark, []) == []
    zero = [(50, [0.0, 1.0], 1), (60, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (70, [2.0, 0.0], 2)]  # a positive of score 0 takes negatives of score 0, whatever their ids
    assert mined(spark, zero) == plain_negatives(zero) == [(50, 60, 1, 1, 0, 0), (50, 60, 2, 70, 0, 0)]


def test_keys_sort_by_anchor_score_and_id():
    rng = random.Random(3)
    rows = [(rng.choice([-5, 0, 7, 1 << 40]), rng.choice([-(1 << 60), -3, 0, 3, 1 << 60]), rng.random() < 0.5, rng.randrange(-9, 9)) for _ in range(500)]
    assert [negatives.unpacked(k) for k in sorted(negatives.packed(*r) for r in rows)] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))


def test_windows_of_one_anchor_are_all_that_is_held():
    keys = iter([negatives.packed(1, 100 - i, i > 0, i) for i in range(80)])
    found = negatives.mined(keys, 5, 3, 50, 95)
    assert [next(found)[3] for _ in range(3)] == [5, 6, 7]
    assert list(found) == []


def plain_links(rows, cosine=0.93):
    """(vec_id, n_links, component_id) of each row, by all pairs."""
    width = max([len(v) for _, v, _ in rows if v is not None], default=0)
    good = [i is not None and k is not None and usable(v) and any(v) for i, v, k in rows]
    wide = np.array([[*v, *[0.0] * (width - len(v))] if g else [0.0] * width for g, (_, v, _) in zip(good, rows)])
    wide = wide / np.maximum(np.abs(wide).max(axis=1, initial=1e-300), 1e-300)[:, None]
    norms = np.maximum(np.linalg.norm(wide, axis=1), 1e-300)
    same = np.array([[a[2] == b[2] for b in rows] for a in rows])
    linked = ((wide @ wide.T) / norms[:, None] / norms[None] >= cosine) & same & np.outer(good, good)
    np.fill_diagonal(linked, False)
    root = list(range(len(rows)))
    for _ in rows:
        before = list(root)
        for a, b in zip(*np.nonzero(linked)):
            root[a] = min(root[a], root[b])
        if root == before:
            break
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root) if all(rows[i][0] is not None for i in range(len(rows)) if root[i] == r)}
    return sorted(((rows[i][0], int(linked[i].sum()), least.get(root[i])) for i in range(len(rows))), key=str)


def found_links(spark, rows, **how):
    got = vectordups.near_vectors(table(spark, rows), **how).collect()
    assert all(r.kept == (r.component_id is None or r.component_id == r.vec_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


@pytest.mark.parametrize("block", [1024, 40])
def test_vector_links_match_brute_force(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, rng.normal(size=16).tolist(), int(rng.integers(0, 2))) for i in range(150)]
    for c, n in zip(range(12), [2, 2, 3, 3, 4, 5, 6, 8, 10, 20, 60, 130]):  # groups from two to many, at the threshold and closer
        rows += [(1000 + 200 * c + i, (centres[c] + rng.normal(0, 0.04 + 0.02 * (c % 6), 16)).tolist(), 1) for i in range(n)]
    rows += [(9000 + i, rows[200][1], 1) for i in range(25)] + [(9100 + i, [2 * x for x in rows[200][1]], 1) for i in range(3)]  # copies, and one direction at another length
    random.Random(1).shuffle(rows)
    want = plain_links(rows)
    assert sum(n for _, n, _ in want) > 10_000
    assert found_links(spark, rows, block=block) == want


def test_vector_links_odd_rows(spark):
    more = [(400, [1e300, 1e300], 1), (401, [1e-300, 1e-300], 1), (402, [1.0, 1.0], 2), (403, [0.0, 0.0, 1e-9], 1), (403, [0.0, 0.0, 2.0], 1), (403, [1.0, 1.0, 0.0], 1)]
    assert found_links(spark, ODD_VECTORS + more) == plain_links(ODD_VECTORS + more)
    assert found_links(spark, []) == []
    strings = spark.createDataFrame([(1, [1.0], "a"), (2, [3.0], "a"), (3, [1.0], "b")], "vec_id long, embedding array<float>, label string")
    assert sorted(map(tuple, vectordups.near_vectors(strings).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_tables_miss_as_few_as_the_formula_says():
    """Pairs at the threshold: of a table, the share that shares its cells; of all tables, next to none is lost."""
    rng = np.random.default_rng(5)
    a = vectordups.normalised(rng.normal(size=(4000, 64)))
    side = rng.normal(size=a.shape)
    side = vectordups.normalised(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * side
    same = vectordups.table_keys(a, vectordups.TABLES, vectordups.PROJECTIONS) == vectordups.table_keys(b, vectordups.TABLES, vectordups.PROJECTIONS)
    assert same.mean() == pytest.approx(1 - vectordups.missed(0.93, tables=1), abs=0.004)
    assert same.any(axis=1).mean() > 0.999 and vectordups.missed(0.93) < 2e-5


def test_pairs_count_in_one_table():
    """Whatever the tables that two vectors share, their link is counted once, and copies count as many times as there are."""
    import pyarrow as pa

    unit = np.array([1.0, 0.0]).tobytes()
    keys = [np.array(k, np.int32).tobytes() for k in ([7, 1, 3], [7, 2, 3], [5, 2, 3])]
    rows = [(no, t, bucket) for bucket, (t, nos) in enumerate([(0, [0, 1]), (1, [1, 2]), (2, [0, 1, 2])]) for no in nos]
    batch = pa.RecordBatch.from_pylist([{"no": no, "t": t, "bucket": k, "i": 0, "j": 0, "is_left": True, "label": "x", "copies": no + 1, "unit": unit, "keys": keys[no]} for no, t, k in rows])
    found = [r for out in vectordups.compared(iter([batch.slice(0, 3), batch.slice(3)]), 0.93) for r in out.to_pylist()]
    total = Counter()
    for r in found:
        if r["b"] is None:
            total[r["a"]] += r["n"]
    assert total == {0: 2 + 3, 1: 1 + 3, 2: 1 + 2}


def plain_collocations(rows, least=10, percent=50, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        totals[lang] += 0
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    candidates = {k: a for k, a in counts.items() if len(k) > 2 and a >= least}
    gone = {(k[0], *part) for k, a in candidates.items() if len(k) == 4 for part in (k[1:3], k[2:4]) if candidates.get((k[0], *part)) and 100 * a >= percent * candidates[(k[0], *part)]}
    out = []
    for lang in totals:
        own = []
        for k, a in candidates.items():
            if k[0] == lang and k not in gone:
                s, _, l, r = min((1_000_000 * a * a // (counts[k[: 1 + i]] * counts[(lang, *k[1 + i :])]), i, counts[k[: 1 + i]], counts[(lang, *k[1 + i :])]) for i in range(1, len(k) - 1))  # noqa: E741
                own.append((-s, -a, " ".join(k[1:]).encode(), l, r))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(own)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -s))
    return sorted(out)


def found_collocations(spark, rows, **how):
    docs = spark.createDataFrame([(t, g, 1, "x", 2, 3) for t, g in rows], "text string, lang string, w1 int, phrase string, n int, f int")
    return sorted(map(tuple, collocations.collocations(docs, **how).collect()))


def texts_of(seed, n):
    rng = random.Random(seed)
    words = ["The", "of", "Été", "café", "a", "bb", "日本", "x\x00y", "don't", "-", "new", "york", "city"]
    out = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b", "! "]) for _ in range(rng.randrange(0, 60)))
        out.append((text + "New York City " * rng.randrange(3), rng.choice(["en", "fr", None, "und", ""])))
    return out


def test_collocations_match_brute_force(spark):
    rows = texts_of(1, 300) + [(None, "en"), ("", "fr"), (None, None), ("one two", "rare"), (" . ", "blank")]
    assert found_collocations(spark, rows) == plain_collocations(rows)
    assert found_collocations(spark, rows, top=7) == plain_collocations(rows, top=7)
    assert found_collocations(spark, rows[:20], least=1, percent=90) == plain_collocations(rows[:20], 1, 90)
    assert found_collocations(spark, []) == []


def test_collocations_of_runs_cut_inside_pieces(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(" ".join(rng.choice("abcd") for _ in range(4000)), "en"), ("a b c " * 500 + ". " + "d" * 300 + " a b", "en"), ("x" * 5000, "fr"), ("\n".join(["a b c"] * 200), "fr")]
    text = rows[1][0].encode()
    for most in (1, 7, 64, 100_000):
        total = Counter()
        bits = np.full(collocations.FILTER_BITS // 8, 255, np.uint8)
        for before, part in collocations.runs(text.translate(collocations._CLEAN), most):
            run = collocations.Counts(part, before)
            names = [w.decode() for w in run.words.to_pylist()]
            for codes in (run.ones(), run.twos(), run.threes(bits)):
                total.update({tuple(names[i] for i in key): int(n) for *key, n in zip(*codes)})
        want = Counter()
        for piece in text.decode().split("."):
            words = piece.split()
            want.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
        assert total == want
    assert found_collocations(spark, rows) == plain_collocations(rows)


def test_a_full_filter_only_costs_time(spark, monkeypatch):
    rows = texts_of(2, 60)
    monkeypatch.setattr(collocations, "frequent_filter", lambda short: np.full(collocations.FILTER_BITS // 8, 255, np.uint8))
    assert found_collocations(spark, rows, least=3) == plain_collocations(rows, least=3)


def test_streams_carry_over_partitions(spark):
    """Counts reach phrases whose first words stand in an earlier partition, as those of a frequent word do."""
    grams = [("en", "a", None, None, 5000)] + [("en", "a", f"b{i:04d}", None, 100 + i) for i in range(400)] + [("en", "a", "b0007", f"c{i:03d}", 1) for i in range(300)] + [("fr", "a", None, None, 7), ("fr", "a", "b", None, 3)]
    rows = spark.createDataFrame(grams, "lang string, w1 string, w2 string, w3 string, f long").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r[:4]: r[-2:] for r in collocations.read_in_order(rows, ["w1", "w2", "w3"], "one", "two").select("lang", "w1", "w2", "w3", "one", "two").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert len(got) == len(grams)
    assert all(one == (5000 if k[0] == "en" else 7) for k, (one, _) in got.items())
    assert all(got[k][1] == 107 for k in got if k[3] is not None)


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**13 + 7, 10**13 + 9, 10**13 + 11), (3, 10**13, 7), (10**13, 10**13, 10**13), (10, 30, 70)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert {r.s: None for r in got} == {1_000_000 * a * a // (l * r): None for a, l, r in rows}  # noqa: E741
