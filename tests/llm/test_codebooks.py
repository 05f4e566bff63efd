"""Codebooks by two trees against Lloyd's rounds in plain integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from creditloom.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int"


def encoded(spark, rows, schema=SCHEMA, **how):
    got = codebooks.encode(spark.createDataFrame(rows, schema).repartition(3), **how).collect()
    return sorted(((r["vec_id"], r["label"], r["code"], r["error"], r["label_error"], r["codebooks"]) for r in got), key=repr)


def wanted(rows, **how):
    kept = sorted((i, v, label) for i, v, label in rows)
    codes, books = brute.lloyd([(i, v) for i, v, _ in kept], **how)
    total = {}
    for (_, _, label), (_, error) in zip(kept, codes, strict=True):
        total[label] = total.get(label, 0) + error
    text = ",".join(str(c) for book in books for e in book for c in e)
    return sorted(((i, label, code, error, total[label], text) for (i, _, label), (code, error) in zip(kept, codes, strict=True)), key=repr)


def clustered(seed, n, dims, clusters, spread):
    chance = random.Random(seed)
    centres = [[chance.uniform(-1, 1) for _ in range(dims)] for _ in range(clusters)]
    return [(k * 3, [float(np.float32(x + chance.gauss(0, spread))) for x in chance.choice(centres)], k % 4) for k in range(n)]


@pytest.mark.parametrize("spread", [0.0, 0.01, 0.5])
def test_against_plain_rounds(spark, spread):
    rows = clustered(1, 400, 16, 9, spread)
    assert encoded(spark, rows) == wanted(rows)


def test_ties_and_few_vectors(spark):
    grid = [(i, [float(x) / 4096 for x in (i % 3, i // 3 % 3, i % 2, 0)], None) for i in range(60)]
    assert encoded(spark, grid, parts=2, entries=4) == wanted(grid, parts=2, entries=4)
    same = [(i, [0.25] * 8, i % 2) for i in range(30)]
    assert encoded(spark, same) == wanted(same)
    few = clustered(2, 5, 8, 2, 0.1)
    assert encoded(spark, few) == wanted(few)


def test_whole_nodes_are_assigned_by_cached_sums():
    """On parts that lie in clusters far apart most are never compared with an entry one by one."""
    chance = np.random.default_rng(3)
    centres = chance.integers(-4000, 4000, (16, 4))
    points = (centres[chance.integers(0, 16, 4096)] + chance.integers(-3, 4, (4096, 4))).astype(np.int64)
    tree = codebooks.PointTree.over(points[codebooks.tree_order(points)])
    codes, counts, sums, whole = codebooks.nearest(tree, centres.astype(np.int64))
    far = ((tree.points[:, None, :] - centres[None]) ** 2).sum(2)
    assert (codes == far.argmin(1)).all() and (counts == np.bincount(codes, minlength=16)).all()
    assert all((sums[e] == tree.points[codes == e].sum(0)).all() for e in range(16))
    assert whole > 3000


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 33, 1000])
def test_trees_hold_every_point(n):
    points = np.random.default_rng(n).integers(-50, 50, (n, 3))
    order = codebooks.tree_order(points)
    assert sorted(order.tolist()) == list(range(n))
    tree = codebooks.PointTree.over(points[order].astype(np.int64))
    for edges, low, high, sums in zip(tree.edges, tree.low, tree.high, tree.sums, strict=True):
        assert edges[0] == 0 and edges[-1] == n
        for a, b, x, y, s in zip(edges[:-1], edges[1:], low, high, sums, strict=True):
            own = tree.points[a:b]
            assert (own.min(0) == x).all() and (own.max(0) == y).all() and (own.sum(0) == s).all()


def test_unusable_and_repeated_rows(spark):
    good = clustered(4, 40, 8, 3, 0.2)
    nan, inf = float("nan"), math.inf
    bad = [(1000, None, 1), (1001, [nan] * 8, 1), (1002, [0.0] * 7 + [inf], 1), (1003, [0.0] * 7 + [None], 1)]
    odd = [(1004, [1.0] * 4, 1), (1005, [1e20] * 8, None), (1006, [], 2)]
    got = encoded(spark, good + bad + odd)
    assert [r for r in got if r[0] < 1000] == wanted(good)
    assert {r[0] for r in got if r[0] >= 1000} == {1004, 1005, 1006} and all(r[2:5] == (None, None, None) for r in got if r[0] >= 1000)
    twice = good + good[:7]
    assert encoded(spark, twice) == wanted(twice)
    unnamed = [(None, good[0][1], 9), *good]
    assert len([r for r in encoded(spark, unnamed) if r[0] is None and r[2]]) == 1


def test_empty_and_clashing(spark):
    assert encoded(spark, []) == []
    rows = clustered(5, 30, 8, 3, 0.2)
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("id", "vector", "code", "error", "same", "points")])
    got = codebooks.encode(docs)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks"]
    assert sorted((r["vec_id"], r["code"]) for r in got.collect()) == [(w[0], w[2]) for w in sorted(wanted(rows))]
    uneven = [(i, [0.5] * 9, 0) for i in range(20)]
    assert all(r[2] is None for r in encoded(spark, uneven))
    with pytest.raises(ValueError):
        codebooks.encode(docs, entries=257)
