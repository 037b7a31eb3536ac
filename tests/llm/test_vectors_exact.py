"""Operators 12 and 13 against brute force in Python's integers: copies, ties, odd rows, several blocks, every pruning path."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.llm import bond, normed
from cutline.llm import vectors as V

MAX, MIN = (1 << 63) - 1, -(1 << 63)
FRAME = "vec_id long, embedding array<double>, label int, norm string, score double, dims int"


def whole(rows, scale, labels=False):
    out = {}
    for i, vec, label, *_ in rows:
        if i is None or vec is None or (labels and label is None) or any(x is None or not math.isfinite(scale * x) for x in vec):
            continue
        out[i] = ([math.floor(scale * x) for x in vec], label)
    return out


def dot(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), MIN), MAX)


def brute_top(rows, every, k, scale=1024.0):
    v = whole(rows, scale)
    out = set()
    for q in v:
        if q % every == 0:
            near = sorted((-dot(v[q][0], v[i][0]), i) for i in v if i != q and len(v[i][0]) == len(v[q][0]))
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(near[:k], 1)}
    return out


def brute_mine(rows, every, scale=256.0, k=5):
    v = whole(rows, scale, labels=True)
    out = set()
    for a in v:
        if a % every:
            continue
        near = sorted((-dot(v[a][0], v[i][0]), i) for i in v if i != a and len(v[i][0]) == len(v[a][0]))
        for s, p in [x for x in near if v[x[1]][1] == v[a][1]][:k]:
            fit = [x for x in near if v[x[1]][1] != v[a][1] and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out |= {(a, p, rank, i, -s, -t) for rank, (t, i) in enumerate(fit[:k], 1)}
    return out


def clustered(n, dims, seed, spread=0.05, lengths=(0.2, 3.0)):
    draw = np.random.default_rng(seed)
    centers = draw.normal(size=(12, dims))
    x = centers[draw.integers(12, size=n)] + draw.normal(size=(n, dims)) * spread
    x *= draw.uniform(*lengths, size=(n, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0]  # a third of all rows hold one vector
    return [(i, v.tolist(), int(draw.integers(3)), "x", 0.0, 1) for i, v in enumerate(x)]


ODD = [
    (0, [1.0, 0.5], 1), (10, [0.0, 0.0], 1), (20, None, 1), (30, [float("nan"), 1.0], 1), (40, [None, 1.0], 1), (50, [float("inf"), 1.0], 1), (60, [], 1), (70, [], 2), (1, [1.0, 1.0], 2),
    (2, [-1.0, 0.25], 1), (2, [-1.0, 0.25], 1), (None, [1.0, 0.0], 1), (80, [1.0, 2.0, 3.0], 1), (90, [1.0, 2.0, 3.0], 2), (100, [1.0, 2.0, 3.5], None), (110, [1e300, 1.0], 1), (3, [1e300, 2.0], 2),
    (4, [1e9, 1e9], 1), (120, [1e9, 1.0], 2), (5, [1e307, 1.0], 1), (130, [-1e300, 7.0], 1), (6, [1e300, 2.0], 1), (7, [0.9, 0.4], 1), (8, [0.9, 0.45], 2), (9, [-0.0, 0.0], 2),
]
ODD = [(*r, "x", 0.0, 1) for r in ODD]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("settings", [normed.Settings(), normed.Settings(bucket_rows=37, query_rows=20), normed.Settings(bucket_rows=64, coordinate_from=2.0), normed.Settings(bucket_rows=50, coordinate_from=0.0, focus=5)])
def test_norm_buckets(spark, settings):
    rows = clustered(600, 6, 1)
    got = rows_of(normed.search(spark.createDataFrame(rows, FRAME), F.col("id") % 10 == 0, settings=settings))
    assert got == sorted(brute_top(rows, 10, 10))


def test_coordinates_prune(monkeypatch):
    """Both ways of pruning a bucket are taken, and fewer products are made than pairs."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(12, 8))[draw.integers(12, size=2_000)] + draw.normal(size=(2_000, 8)) * 0.02
    x *= draw.uniform(0.9, 1.0, size=(2_000, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    m = np.floor(1024 * x)
    norms = np.linalg.norm(m, axis=1)
    order = np.argsort(-norms)
    block = V.Block(np.arange(2_000)[order], np.zeros(2_000, np.int32), norms[order], m[order])
    queries = V.Block(np.arange(5_000, 5_050), np.zeros(50, np.int32), norms[:50], m[:50])
    made = []
    products = V.products
    monkeypatch.setattr(V, "products", lambda q, v: made.append(len(q) * len(v)) or products(q, v))
    exact = m[:50] @ m.T
    best = normed._Best(queries, 5, np.sort(exact, axis=1)[:, -60])
    normed._search(best, block, normed.Settings())
    assert sum(made) < 50 * 2_000 * 2 / 5 and len(made) > 10
    for i in range(50):
        assert list(best.ids[i]) == [j for _, j in sorted((-s, j) for j, s in enumerate(exact[i]))[:5]]


@pytest.mark.parametrize("settings", [bond.Settings(), bond.Settings(block_rows=29, anchor_rows=16, step=2)])
def test_vertical_scan(spark, settings):
    rows = clustered(500, 10, 2, spread=0.3)
    got = rows_of(bond.mine(spark.createDataFrame(rows, FRAME), F.col("id") % 10 == 0, settings=settings))
    want = sorted(brute_mine(rows, 10))
    assert got == want and len(want) > 500


def test_scan_drops_rows_early():
    draw = np.random.default_rng(4)
    m = np.floor(256 * draw.normal(size=(40, 3_000)))
    columns = bond.Columns(V.Block(np.arange(3_000), np.zeros(3_000, np.int32), np.ones(3_000), m))
    anchor = m[:, 0] * (np.arange(40) < 6)
    sizes = []

    def wanted(lower, upper):
        sizes.append(len(lower))
        return upper >= bond._nth(lower, 5)

    alive, scores = columns.scan(anchor, np.arange(3_000), wanted, 4)
    exact = anchor @ m
    assert set(np.argsort(-exact)[:5]) <= set(alive) and (scores == exact[alive].astype(np.int64)).all()
    assert sizes[0] == 3_000 and sizes[-1] < 50


def test_odd_rows(spark):
    frame = spark.createDataFrame(ODD, FRAME)
    assert rows_of(normed.search(frame, F.col("id") % 10 == 0)) == sorted(brute_top(ODD, 10, 10))
    assert rows_of(bond.mine(frame, F.col("id") % 10 == 0)) == sorted(brute_mine(ODD, 10))
    empty = spark.createDataFrame([], FRAME)
    assert normed.search(empty, F.col("id") % 10 == 0).count() == 0 and bond.mine(empty, F.col("id") % 10 == 0).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None, None)] * 3, FRAME)
    assert normed.search(nulls, F.col("id") % 10 == 0).count() == 0 and bond.mine(nulls, F.col("id") % 10 == 0).count() == 0


def test_one_row_for_each_id(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [0.5, 0.0], 1), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1)]
    got = rows_of(normed.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("id") % 10 == 0))
    assert [(r[0], r[1], r[2]) for r in got] == [(0, 1, 1)]


def test_packed_blocks(spark):
    rows = [(i, [float(i)] * (1 + i % 3), i % 2, "x", 0.0, 1) for i in range(100)]
    packed = V.packed(V.whole(spark.createDataFrame(rows, FRAME), 1.0, "vec_id", "embedding", "label").coalesce(1), 10)
    blocks = [b for q in V.query_blocks(packed, 25) for b in q.values()]
    assert sorted(i for b in blocks for i in b.ids) == list(range(100))
    assert all((b.m == b.ids[:, None]).all() and (b.labels == b.ids % 2).all() for b in blocks) and max(len(b.ids) for b in blocks) <= 40
