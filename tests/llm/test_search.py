"""Exact top-k search against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from querytide.llm import kdtree


def brute(rows, k, every):
    held = [(i, v, [max(-(1 << 27), min(1 << 27, math.floor(256 * x))) for x in e]) for i, (v, e) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, e in held:
        if v is not None and v % every == 0:
            found = sorted((-sum(a * b for a, b in zip(e, f, strict=False)), w is None, w or 0) for j, w, f in held if j != i)[:k]
            out += [(v, r, None if none else w, -s) for r, (s, none, w) in enumerate(found, 1)]
    return sorted(out, key=str)


def searched(spark, rows, k=5, every=10, **sizes):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, row string, kth int")
    return sorted((tuple(r) for r in kdtree.top_k(df, F.col("vec_id") % every == 0, k, **sizes).collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_top_k_matches_brute_force(spark, seed):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(5)] for _ in range(4)]
    rows = [(i, [float(np.float32(c + r.choice([0, 0, 0.1, -0.3]))) for c in r.choice(centres)]) for i in range(300)]  # many ties
    assert searched(spark, rows, shard=64, leaf=8, block=7) == brute(rows, 5, 10)


def test_top_k_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (10, None), (20, [None, 1.0]), (30, [float("nan"), 1.0]), (40, [float("inf"), 1.0]), (None, [1.0, 2.0]), (50, []), (60, [1.0]), (0, [1.0, 2.0]), (7, [1e38, -1e38]), (70, [1.0, 2.0, 3.0])]
    assert searched(spark, rows) == brute(rows, 5, 10)


def test_top_k_few_and_no_rows(spark):
    assert searched(spark, []) == []
    assert searched(spark, [(10, [1.0])]) == []
    assert searched(spark, [(10, [1.0]), (3, [-1.0])]) == [(10, 1, 3, -65536)]


def test_tree_boxes_hold_their_points_and_bounds_hold():
    r = np.random.default_rng(3)
    points = r.integers(-50, 50, (500, 6))
    tree = kdtree.Tree(np.arange(500), np.arange(500), points, 16)
    queries = r.integers(-50, 50, (9, 6))
    bound, again = tree.bounds(queries), kdtree.Tree.unpacked({k: v[0] for k, v in tree.packed().items()})
    for n, (a, b) in enumerate(tree.nodes):
        own = tree.points[a:b]
        assert (own.min(0) == tree.low[n]).all() and (own.max(0) == tree.high[n]).all()
        assert ((queries @ own.T).max(1) <= bound[:, n]).all()
        assert tree.child[n] or b - a <= 16
        if c := tree.child[n]:
            assert {*map(tuple, tree.nodes[c : c + 2])} == {(a, (a + b) // 2), ((a + b) // 2, b)}
    ids, scores = again.search(np.full(9, -1), queries, np.full(9, kdtree._LOW + 1), 4)
    made = queries @ points.T
    assert (scores == -np.sort(-made, axis=1)[:, :4]).all()
    assert (np.take_along_axis(made, ids, 1) == scores).all()


def test_products_beyond_doubles_are_exact():
    a = np.array([[1 << 27, 1]])
    assert kdtree.product(a, a)[0, 0] == (1 << 54) + 1
