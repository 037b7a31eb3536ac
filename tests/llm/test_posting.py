"""Recall against brute force, exact scores, ties and odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from cutline.llm import posting as P

SF = "/root/testdata/sf0.1"


def brute(ids, x, queries, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        score = u @ u[q]
        order = [i for i in np.lexsort((ids, -score)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def found_by(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = table.toPandas().sort_values("vec_id")
    ids, x = data.vec_id.to_numpy(), np.stack(data.embedding.to_numpy()).astype(float)
    found = found_by(P.search(table, F.col("id") % 10 == 0, settings=P.Index(list_rows=16)).collect())
    want = brute(ids, x, np.flatnonzero(ids % 10 == 0))
    assert found.keys() == want.keys() and all(len(v) == 5 for v in found.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.95
    u = dict(zip(ids, x / np.linalg.norm(x, axis=1, keepdims=True)))
    for q, rows in found.items():
        assert all(abs(score - u[q] @ u[i]) < 1e-12 for i, score in rows)
        assert [(-s, i) for i, s in rows] == sorted((-s, i) for i, s in rows)


def test_copies_and_blocks(spark):
    """A third of all rows hold one vector; lists are dealt to several tasks."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 8)).round(3)
    x[::3] = x[0]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    settings = P.Index(list_rows=40, block_rows=7, probe_ratio=9.0, boundary=9.0)
    found = found_by(P.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, entry string"), F.col("id") % 50 == 0, settings=settings).collect())
    want = brute(np.arange(300), x, range(0, 300, 50))
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (150, [float("nan"), 1.0]), (200, [None, 1.0]), (250, [float("inf"), 1.0]), (300, []), (1, [1.0, 1.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (350, [1.0, 2.0, 3.0])]
    found = found_by(P.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).collect())
    assert [i for i, _ in found[0]] == [2, 1] and abs(found[0][0][1] - 1) < 1e-12 and set(found) == {0}
    assert P.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 50 == 0).count() == 0


def test_parts_are_balanced():
    draw = np.random.default_rng(0)
    x = P.unit(np.concatenate([draw.normal(size=(900, 6)) * 0.01 + 1, draw.normal(size=(100, 6))]))
    assert P.balanced(x, 16, draw).shape == (16, 6)
    graph = P.Graph(P.balanced(x, 64, draw), 8, draw)
    ids, far = graph.nearest(x[:200], 16)
    exact = np.linalg.norm(x[:200, None, :] - graph.centers[None], axis=2).min(1)
    assert (np.abs(far[:, 0] - exact) < 1e-3).mean() > 0.95
