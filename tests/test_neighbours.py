"""Nearest neighbours by matrix products: as exact as pair by pair, and far quicker where an index leaves nothing out."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from segmentry.operators import select
from segmentry.operators.kernels import block_distances, nearest


def plain(a, b, k):
    d = block_distances(a, b)
    few = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(d, few, axis=1), few


def hostile():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(40, 16)), rng.normal(size=(3000, 16))
    copies, broken, far = b.copy(), b.copy(), b.copy()
    copies[100:700] = b[3]
    broken[7, 3], broken[9, 2] = np.nan, np.inf
    far[0] *= 1e7
    return {
        "noise": (a, b), "copies": (np.vstack([a, b[3:4]]), copies), "all alike": (a * 0, b * 0), "not finite": (a, broken), "one far away": (a, far),
        "shifted": (a + 1e6, b + 1e6), "shifted far": (a + 1e9, b + 1e9), "tiny": (a * 1e-25, b * 1e-25), "huge": (a * 1e18, b * 1e18), "grid": (a.round(), b.round()), "few": (a, b[:9]), "none": (a, b[:0]),
    }


@pytest.mark.parametrize("name", hostile())
def test_products_find_what_pairs_find(name):
    a, b = hostile()[name]
    for k in (1, 6):
        with np.errstate(invalid="ignore"):
            got, want = nearest(a, b, k), plain(a, b, k)
        assert np.array_equal(got[0], want[0], equal_nan=True) and np.array_equal(got[1], want[1])


def test_products_are_quicker_than_pairs():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(128, 64)), rng.normal(size=(32_768, 64))

    def took(f):
        began = time.perf_counter()
        f(a, b, 6)
        return time.perf_counter() - began

    assert min(took(nearest) for _ in range(3)) * 5 < took(plain)


def frame(spark, v):
    return spark.createDataFrame([(i, None if x is None else [float(y) for y in x]) for i, x in enumerate(v)], "id long, vec array<double>")


def test_an_index_is_for_clusters_only(spark):
    rng = np.random.default_rng(2)
    clusters = rng.normal(0, 10, (20, 8))[rng.integers(0, 20, 3000)] + rng.normal(0, 0.01, (3000, 8))
    assert select._indexable(frame(spark, clusters), 6, "id", "vec") and not select._indexable(frame(spark, rng.normal(size=(3000, 8))), 6, "id", "vec")


def test_tiles_and_index_agree(spark):
    v = np.random.default_rng(3).normal(size=(3000, 8)).round(1)
    rows = frame(spark, v)
    d = np.sort(block_distances(v[::10], v), axis=1)[:, 5]
    want = {10 * i: x for i, x in enumerate(d)}
    for how in ({}, {"blocks": (70, 900)}, {"pivots": 30}):
        assert {r.id: r.distance for r in select.knn_distance(rows.where("id % 10 = 0"), rows, 5, **how).collect()} == want


def test_null_vectors_are_no_ones_neighbours(spark):
    rows = frame(spark, [[0.0], None, [1.0], [3.0]])
    assert sorted((r.id, r.distance) for r in select.knn_distance(rows, rows, 1).collect()) == [(0, 1.0), (1, None), (2, 1.0), (3, 2.0)]
    assert [r.neighbour for r in select.nearest_neighbour(rows.where("id > 0"), rows.where("id < 2")).orderBy("id").collect()] == [0, 0]


def test_vectors_of_several_lengths_are_refused(spark):
    with pytest.raises(Exception, match="several lengths|inhomogeneous"):
        rows = frame(spark, [[0.0], [1.0, 2.0], [1.0]])
        select.knn_distance(rows, rows, 1).agg(F.sum("distance")).collect()
