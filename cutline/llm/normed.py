"""Exact top-k inner products by norm buckets.

Vectors are sorted by length into buckets of bounded size. For a query with a lower
bound for its k-th score, a bucket gives a local threshold: the least cosine with which
its longest vector could still reach that bound. Over one, the bucket is skipped. Else
the query prunes the bucket either by length (it scans the rows that are long enough)
or, at a high local threshold, by coordinates: a row within the angle has its value on
the query's strongest coordinates in a range, found in the bucket's sorted columns.
What is left is verified by exact products. The bound rises from bucket to bucket.

Queries come a bounded block at a time; all buckets meet the block in one job. The
bucket of the longest vectors is searched first and gives the bounds to start from.
A task keeps ``k`` rows for each query of the block, so no task grows with the table.

Edge cases: vectors that are null or hold null or non-finite components take no part;
zero and empty ones do (their products are 0). Only vectors of one length are compared.
Rows without an id take no part; of rows that share an id one is kept, so a query's own
row is the one with its id. Ties go to the smaller id. Products beyond the range of a
long become its nearest. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutline.llm import vectors as V
from cutline.session import materialize

#: Room for rounding of lengths and cosines: bounds are loosened by it, never tightened.
_SLACK = 1e-9


@dataclass(frozen=True)
class Settings:
    bucket_rows: int = 4_096
    query_rows: int = 16_384
    #: From this local cosine threshold on, coordinates are tried.
    coordinate_from: float = 0.3
    focus: int = 3


class _Best:
    """The ``k`` best found for each query of a block."""

    def __init__(self, queries: V.Block, k: int, bounds: np.ndarray):
        self.q, self.k, self.bounds = queries, k, bounds
        self.scores = np.full((len(queries.ids), k), V.LEAST, np.int64)
        self.ids = np.full((len(queries.ids), k), V.MOST, np.int64)
        self.found = np.zeros(len(queries.ids), np.int64)

    def least(self) -> np.ndarray:
        """A lower bound of each query's k-th score: minus infinity while there is none."""
        own = np.where(self.found >= self.k, self.scores[:, -1].astype(np.float64), -np.inf)
        return np.maximum(own, self.bounds)

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        bound = max(self.bounds[query], self.scores[query, -1] if self.found[query] >= self.k else -np.inf)
        held = (ids != self.q.ids[query]) & (scores >= bound)
        if not held.any():
            return
        n = int(self.found[query])
        scores, ids = np.concatenate([self.scores[query, :n], scores[held]]), np.concatenate([self.ids[query, :n], ids[held]])
        top = V.best(scores, ids, self.k)
        self.scores[query, : len(top)], self.ids[query, : len(top)], self.found[query] = scores[top], ids[top], len(top)


def _ranges(q: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a unit vector within the angle of ``cosine`` has a coordinate on which the query has ``q``."""
    turn, lean = np.arccos(np.clip(cosine, -1, 1)), np.arccos(np.clip(q, -1, 1))
    return np.cos(np.minimum(np.pi, lean + turn)) - _SLACK, np.cos(np.maximum(0, lean - turn)) + _SLACK


def _search(best: _Best, bucket: V.Block, settings: Settings) -> None:
    """One bucket, longest rows first, against all queries of the block."""
    q, longest = best.q, bucket.norms[0]
    bound = best.least()
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        live = np.flatnonzero(~(bound > q.norms * longest * (1 + _SLACK)))
        bound, size = bound[live], q.norms[live]
        cosine = np.where((bound > 0) & np.isfinite(size * longest), bound / (size * longest), 0.0)
        enough = np.where(bound > 0, bound / size * (1 - _SLACK), 0.0)
    prefix = np.searchsorted(-bucket.norms, -enough, side="right")
    scanned = np.ones(len(live), bool)
    sharp = np.flatnonzero(cosine >= settings.coordinate_from)
    if len(sharp) and q.m.shape[1]:
        with np.errstate(invalid="ignore", divide="ignore"):
            unit = np.where(bucket.norms[:, None] > 0, bucket.m / bucket.norms[:, None], 0.0)
        order = np.argsort(unit, axis=0, kind="stable")
        column = np.take_along_axis(unit, order, axis=0)
        direction = q.m[live[sharp]] / size[sharp][:, None]
        focus = np.argsort(-np.abs(direction), axis=1)[:, : settings.focus]
        low, high = _ranges(np.take_along_axis(direction, focus, 1), cosine[sharp][:, None] - _SLACK)
        begin, end = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for d in np.unique(focus):
            at = np.nonzero(focus == d)
            begin[at], end[at] = np.searchsorted(column[:, d], low[at]), np.searchsorted(column[:, d], high[at], side="right")
        tightest = (end - begin).argmin(1)
        for i, j in enumerate(sharp):
            t = tightest[i]
            if 2 * (end[i, t] - begin[i, t]) > prefix[j]:
                continue  # the lengths leave no more rows than the coordinates, and need no lookups
            scanned[j] = False
            rows = order[begin[i, t] : end[i, t], focus[i, t]]
            rows = rows[rows < prefix[j]]
            for f in range(focus.shape[1]):
                if f != t:
                    value = unit[rows, focus[i, f]]
                    rows = rows[(value >= low[i, f]) & (value <= high[i, f])]
            if len(rows):
                query = live[j]
                best.add(query, V.products(q.m[query : query + 1], bucket.m[rows])[0], bucket.ids[rows])
    by_length = np.flatnonzero(scanned & (prefix > 0))
    by_length = by_length[np.argsort(-prefix[by_length], kind="stable")]
    step = max(1, (1 << 21) // len(bucket.ids))
    for first in range(0, len(by_length), step):
        part = by_length[first : first + step]
        rows = int(prefix[part[0]])
        scores = V.products(q.m[live[part]], bucket.m[:rows])
        for i, j in enumerate(part):
            best.add(live[j], scores[i, : prefix[j]], bucket.ids[: prefix[j]])


def _retrieve(block: dict[int, V.Block], k: int, bounds: dict[int, np.ndarray], settings: Settings):
    def run(batches):
        held = {}
        for bucket in V.unpacked_rows(batches):
            dims = bucket.m.shape[1]
            if dims in block:
                if dims not in held:
                    held[dims] = _Best(block[dims], k, bounds.get(dims, np.full(len(block[dims].ids), -np.inf)))
                _search(held[dims], bucket, settings)
        for best in held.values():
            for first in range(0, len(best.found), 4_096):
                n = best.found[first : first + 4_096]
                at = np.arange(k) < n[:, None]
                rows = slice(first, first + 4_096)
                yield pa.record_batch([pa.array(np.repeat(best.q.ids[rows], n)), pa.array(best.ids[rows][at]), pa.array(best.scores[rows][at])], names=["query_id", "vec_id", "score"])

    return run


_FOUND = "query_id long, vec_id long, score long"


def ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def buckets(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Stored buckets, each holding the rows of one stretch of lengths, longest first."""
    order = [F.col("dims"), F.desc("norm"), F.col("id")]
    return materialize(V.packed(rows.repartitionByRange(*order).sortWithinPartitions(*order), settings.bucket_rows), "norm-buckets")


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest products of floor(scale * x) for each row for which ``is_query`` (a test of ``id``) holds."""
    rows = materialize(V.whole(vectors, scale, id_col, vec_col), "whole")
    stored = buckets(rows, settings)
    asked = V.packed(rows.where(is_query), settings.bucket_rows)
    top = stored.agg(F.max("longest")).first()[0]
    first = stored.where(F.col("longest") == top).limit(1) if top is not None else None
    parts = []
    for block in V.query_blocks(asked, settings.query_rows):
        opening = first.mapInArrow(_retrieve(block, k, {}, settings), _FOUND).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        least = {r.query_id: r.least for r in opening.where(F.col("n") == k).collect()}  # one row for each query of the block at most
        bounds = {dims: np.array([least.get(int(i), -np.inf) for i in b.ids], np.float64) for dims, b in block.items()}
        parts.append(materialize(ranked(stored.mapInArrow(_retrieve(block, k, bounds, settings), _FOUND), k), "products"))
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
