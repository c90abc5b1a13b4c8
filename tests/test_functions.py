import pytest
from pyspark.sql import functions as F
from segmentry.functions import preference, replies, rewards
from segmentry.operators import audit

REPLIES = [
    ("-1", -1, -1, None), ("0", 0, 0, -1.0), ("1", 1, 1, 1.0), ("0.8", 0, 0, 0.6), ("Image 1", 1, 1, None), ("0-1", 0, -1, None), ("10", 0, 0, 19.0),
    ("I am not sure", -1, -1, None), ("both look the same", -1, -1, None), ("2", -1, -1, 3.0), ("", -1, -1, None), (None, -1, -1, None), ("nan", -1, -1, None),
]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_replies(spark):
    rows = spark.createDataFrame([(i, r[0]) for i, r in enumerate(REPLIES)], "i int, reply string")
    c = F.col("reply")
    out = rows.select("i", replies.parse_preference(c).alias("p"), replies.parse_single(c).alias("s"), replies.parse_score(c).alias("v")).orderBy("i").collect()
    for row, (reply, p, s, v) in zip(out, REPLIES):
        assert (row.p, row.s) == (p, s), reply
        assert row.v == pytest.approx(v) if v is not None else row.v is None, reply


def test_reasoning_is_dropped(spark):
    assert value(spark, replies.parse_preference(F.lit("<think>maybe\n1</think> 0"))) == 0


@pytest.mark.parametrize("text, first, last", [("1\nfoo", 1, -1), ("x\n0", -1, 0), ("7", -1, -1)])
def test_parse_int(spark, text, first, last):
    assert value(spark, replies.parse_int(F.lit(text), "first")) == first
    assert value(spark, replies.parse_int(F.lit(text), "last")) == last


def test_bradley_terry(spark):
    p, q = preference.bt_probability(F.lit(1.0), F.lit(0.0)), preference.bt_probability(F.lit(0.0), F.lit(1.0))
    assert value(spark, p) == pytest.approx(0.731059, abs=1e-6)
    assert value(spark, p + q) == pytest.approx(1)
    assert value(spark, preference.bt_entropy(F.lit(1.0), F.lit(0.0))) == pytest.approx(0.582203, abs=1e-6)
    assert value(spark, preference.bt_entropy(F.lit(900.0), F.lit(-900.0))) == 0


def test_teacher_and_targets(spark):
    one = F.lit(1.0)
    assert value(spark, preference.teacher_label(one, one, one, one, F.lit(1))) == 0
    assert value(spark, preference.teacher_label(one, one, one, one, F.lit(1), thres_equal=0.1)) == -1
    assert value(spark, preference.soft_target(F.lit(0), 0.1)) == pytest.approx([0.9, 0.1])
    assert value(spark, preference.soft_target(F.lit(-1), 0.1)) == [0.5, 0.5]


def test_tolerance(spark):
    for x, want in ((0.03, 1.0), (0.10, 0.307692), (0.15, 0.1)):
        assert value(spark, rewards.tolerance(F.lit(x), (0, 0.05), 0.1, "long_tail", 0.1)) == pytest.approx(want, abs=1e-6)
    for sigmoid in rewards.SIGMOIDS:
        assert value(spark, rewards.tolerance(F.lit(2.0), (0, 1), 1.0, sigmoid, 0.1)) == pytest.approx(0.1)
    with pytest.raises(ValueError):
        rewards.tolerance(F.lit(1.0), (1, 0))
    with pytest.raises(ValueError):
        rewards.tolerance(F.lit(1.0), (0, 1), 1.0, "gaussian", 0.0)


def test_products(spark):
    assert value(spark, rewards.hamacher(F.lit(0.5), F.lit(0.5))) == pytest.approx(1 / 3)
    assert value(spark, rewards.hamacher(F.lit(0.0), F.lit(0.0))) == 0
    half = [F.lit(0.5)] * 3
    assert value(spark, rewards.rect_prism_tolerance(half, [0, 0, 0], [1, 1, 1])) == pytest.approx(0.125)
    assert value(spark, rewards.rect_prism_tolerance([F.lit(2.0), F.lit(0.0), F.lit(0.0)], [0, 0, 0], [1, 1, 1])) == 1


def test_histogram(spark):
    log = spark.createDataFrame([(1.0, 0.0, 0), (0.0, 1.0, 0), (2.0, 2.0, 1), (0.0, 10.0, -1), (0.0, 10.0, 1), (float("nan"), 1.0, 1)], "score_1 double, score_2 double, label int")
    rows = {r["bin"]: r for r in audit.difficulty_histogram(log, 10).collect()}
    assert sorted(rows) == list(range(10))
    assert (rows[0]["incorrect"], rows[1]["correct"], rows[1]["incorrect"]) == (100, 50, 50)
    assert (rows[9]["correct"], rows[9]["no_preference"], rows[5]["n"]) == (50, 50, 0)
