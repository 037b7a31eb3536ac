"""Nearest vectors by balanced posting lists.

A bounded sample is cut in halves of equal size until the parts have ``list_rows``
rows at the sample's share of all vectors; the parts' means are the centroids. They are
at most ``max_lists``, so that they and a neighbour graph over them fit every task. Each
vector goes to its nearest list and, where it lies at a boundary, to others whose
centroid is nearly as near. A query walks the graph for its nearest centroids and
reads the lists whose distance is within a ratio of the least, and a few at any rate.

Equal vectors are one entry: no more than the ``k + 1`` smallest ids of a vector can
ever be among the nearest, so the rest are counted out exactly, before the shuffle.
Equal queries are searched once. A list that grows over ``block_rows`` rows is dealt to
several tasks. So a vector that a third of all rows hold costs one entry.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, as queries or candidates; vectors of different length are
never compared; queries with fewer candidates get all that their lists hold; rows
that share an id are kept once for each vector; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutline.session import materialize


@dataclass(frozen=True)
class Index:
    """Bounds and ratios of the index."""

    list_rows: int = 64
    max_lists: int = 8_192
    sample_rows: int = 32_768
    replicas: int = 8
    boundary: float = 1.15
    least_probes: int = 24
    probes: int = 96
    probe_ratio: float = 1.30
    beam: int = 112
    degree: int = 24
    block_rows: int = 4_096
    seed: int = 7


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced(x: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Unit means of ``parts`` (rounded down to a power of two) parts of equal size."""
    groups = [np.arange(len(x))]
    while len(groups) * 2 <= parts:
        halves = []
        for rows in groups:
            v = x[rows]
            a, b = v[rng.integers(len(v))], v[rng.integers(len(v))]
            for _ in range(4):  # two means give the direction in which to halve
                side = v @ (a - b) > 0
                if side.all() or not side.any():
                    break
                a, b = v[side].mean(0), v[~side].mean(0)
            order = np.argsort(v @ (a - b), kind="stable")
            halves += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        groups = halves
    means = np.stack([x[rows].mean(0) for rows in groups])
    size = np.linalg.norm(means, axis=1, keepdims=True)
    return np.where(size > 1e-9, means / np.maximum(size, 1e-9), x[[rows[0] for rows in groups]])


class Graph:
    """Centroids, each with its nearest neighbours and a few far ones; searched best first from spread entries."""

    def __init__(self, centers: np.ndarray, degree: int, rng: np.random.Generator):
        self.centers, n = centers.astype(np.float32), len(centers)
        near = min(degree, n - 1)
        self.edges = np.zeros((n, near + min(4, n - 1)), np.int64)
        for i in range(0, n, 1024):
            like = self.centers[i : i + 1024] @ self.centers.T
            like[np.arange(len(like)), np.arange(i, i + len(like))] = -9
            if near:
                self.edges[i : i + 1024, :near] = np.argpartition(-like, near - 1, axis=1)[:, :near]
        if n > 1:
            self.edges[:, near:] = rng.integers(0, n, (n, self.edges.shape[1] - near))
        self.entries = rng.permutation(n)[: max(64, int(n**0.5))]

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``beam`` centroids of each row and their distances, nearest first (-1 and infinity where there are fewer)."""
        x, rows = x.astype(np.float32), np.arange(len(x))[:, None]
        seen = np.zeros((len(x), len(self.centers)), bool)
        seen[:, self.entries] = True
        far = np.sqrt(np.maximum(2 - 2 * x @ self.centers[self.entries].T, 0))
        ids = np.broadcast_to(self.entries, far.shape)
        pad = max(0, beam - far.shape[1])
        far, ids = np.pad(far, ((0, 0), (0, pad)), constant_values=np.inf), np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)
        order = np.argsort(far, axis=1)[:, :beam]
        far, ids, done = far[rows, order], ids[rows, order], np.zeros((len(x), beam), bool)
        while True:
            open_ = np.where(done | (ids < 0), np.inf, far)
            best = open_.argmin(1)[:, None]
            live = np.isfinite(open_[rows, best])
            if not live.any():
                return ids, far
            done[rows, best] = True
            next_ = self.edges[np.maximum(ids[rows, best][:, 0], 0)]
            first = np.ones(next_.shape, bool)
            order = np.argsort(next_, axis=1, kind="stable")
            first[rows, order[:, 1:]] = next_[rows, order[:, 1:]] != next_[rows, order[:, :-1]]
            fresh = live & first & ~seen[rows, next_]
            seen[rows, next_] |= live
            apart = np.sqrt(np.maximum(2 - 2 * np.einsum("bd,bkd->bk", x, self.centers[next_]), 0))
            far, ids = np.concatenate([far, np.where(fresh, apart, np.inf)], 1), np.concatenate([ids, np.where(fresh, next_, -1)], 1)
            done = np.concatenate([done, np.zeros(next_.shape, bool)], 1)
            order = np.argsort(far, axis=1, kind="stable")[:, :beam]
            far, ids, done = far[rows, order], ids[rows, order], done[rows, order]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the vectors that take part, in double precision."""
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    vec = F.col("vec")
    return rows.where(F.col("id").isNotNull() & vec.isNotNull()).where(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _routed(graph: Graph, beam: int, least: int, most: int, ratio: float, blocks: dict[int, int] | None):
    """Rows (list, block, entry, vec): each vector at its lists. Given the blocks of each list, a row goes to all of them."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = _matrix(part.column("vec"))
                ids, far = graph.nearest(unit(x), max(beam, most))
                chosen = far <= ratio * far[:, :1] + 1e-6
                chosen[:, :least] = True
                chosen[:, most:] = False
                chosen &= ids >= 0
                row, k = np.nonzero(chosen)
                lists = ids[row, k]
                entry = part.column("entry").to_numpy()[row]
                if blocks is None:
                    block = np.zeros(len(lists), np.int64)
                else:
                    many = np.array([blocks.get(int(c), 0) for c in lists], np.int64)
                    row, lists, entry = (np.repeat(v, many) for v in (row, lists, entry))
                    block = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                yield pa.record_batch([pa.array(lists, pa.int32()), pa.array(block, pa.int32()), pa.array(entry, pa.int64()), part.column("vec").take(pa.array(row))], names=["list", "block", "entry", "vec"])

    return run


_ROUTED = "list int, block int, entry long, vec array<double>"


def _scored(k: int):
    """The ``k`` best entries of one block for each query that reads it."""

    def run(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entries) and len(queries):
            v = np.stack(entries["vec"].to_numpy())
            v = v / np.sqrt((v * v).sum(1, keepdims=True))
            names = entries["entry"].to_numpy()
            for i in range(0, len(queries), 512):
                q = np.stack(queries["vec"].iloc[i : i + 512].to_numpy())
                q = q / np.sqrt((q * q).sum(1, keepdims=True))
                like = q @ v.T
                order = np.lexsort((np.broadcast_to(names, like.shape), -like), axis=1)[:, :k]
                score = (q[:, None, :] * v[order]).sum(2)  # summed alike in every block
                rows = np.repeat(queries["entry"].iloc[i : i + 512].to_numpy(), order.shape[1])
                out.append(pd.DataFrame({"query": rows, "entry": names[order].ravel(), "score": score.ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"query": pd.Series(dtype="int64"), "entry": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return run


def _of_length(entries: DataFrame, queries: DataFrame, k: int, settings: Index) -> DataFrame:
    """(query, entry, score) of the best ``k + 1`` entries found for each query; all vectors have one length."""
    n = entries.count()
    share = min(1.0, settings.sample_rows / max(n, 1))
    picked = entries if share == 1.0 else entries.where(F.pmod(F.xxhash64("entry"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = picked.select("vec").limit(2 * settings.sample_rows).toArrow().column("vec").combine_chunks()
    x, rng = unit(_matrix(sample)) if len(sample) else np.zeros((0, 1)), np.random.default_rng(settings.seed)
    if not len(x):
        x = unit(_matrix(entries.select("vec").limit(1).toArrow().column("vec").combine_chunks()))
    lists = int(min(settings.max_lists, max(1, n // settings.list_rows), len(x)))
    graph = Graph(balanced(x[np.lexsort(x.T)], lists, rng), settings.degree, rng)
    placed = materialize(entries.mapInArrow(_routed(graph, 16, 1, settings.replicas, settings.boundary, None), _ROUTED), "postings")
    sizes = {r.list: -(-r["count"] // settings.block_rows) for r in placed.groupBy("list").count().collect()}  # at most max_lists rows
    many = F.create_map(*[F.lit(x) for pair in sizes.items() if pair[1] > 1 for x in pair]) if any(b > 1 for b in sizes.values()) else None
    if many is not None:
        placed = placed.withColumn("block", F.pmod(F.xxhash64("entry"), F.coalesce(many[F.col("list")], F.lit(1))).cast("int"))
    asked = queries.mapInArrow(_routed(graph, settings.beam, settings.least_probes, settings.probes, settings.probe_ratio, sizes), _ROUTED)
    return placed.groupBy("list", "block").cogroup(asked.groupBy("list", "block")).applyInPandas(_scored(k + 1), "query long, entry long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", settings: Index = Index()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row for which ``is_query`` (a test of ``id``) holds."""
    rows = materialize(usable(vectors, id_col, vec_col).distinct(), "vectors")
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    kept = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    entries = materialize(kept.groupBy("vec").agg(F.min("id").alias("entry"), F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    asked = rows.where(is_query)
    named = asked.join(entries.select("vec", "entry"), "vec").select(F.col("id").alias("query_id"), F.col("entry").alias("query"))
    queries = entries.join(asked.select("vec").distinct(), "vec", "left_semi").select("entry", "vec")
    found = None
    for length in [r.n for r in entries.select(F.size("vec").alias("n")).distinct().collect()]:
        same = F.size("vec") == length
        part = _of_length(entries.where(same).select("entry", "vec"), queries.where(same), k, settings)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    nearest = found.groupBy("query", "entry").agg(F.max("score").alias("score")).join(entries.select("entry", "ids"), "entry").select("query", F.explode("ids").alias("vec_id"), "score")
    order = [F.desc("score"), F.asc("vec_id")]
    nearest = nearest.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("nth") <= k + 1).drop("nth")
    own = named.join(nearest, "query").where("query_id <> vec_id")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
