"""Hard negatives by a vertical scan of the dimensions.

Blocks of rows are stored dimension by dimension with the least and the greatest value of
each. An anchor reads a block's dimensions in descending order of its own components. After
each few of them every row has an interval for its product: the sum so far plus the least
and the greatest that the remaining dimensions could add. Rows whose interval misses
what is sought drop out of the bitmap, until the rest have exact products.

Two scans: the best ``positives`` rows of the anchor's label, where the bound is the
worst of the best found so far; then, for each positive, the best ``negatives`` rows of
other labels whose product lies in the window [low * p, p] of the positive's product
p, where the window's floor rises in the same way. A task keeps those rows for each
anchor of a block, no more; blocks of anchors are bounded and meet all rows in one job.

Rows are ordered by label, so a block holds few labels and is skipped as a whole where
they cannot serve. A label with a third of all rows fills many blocks.

Edge cases: rows with a null label or id, a null vector or a null or non-finite
component take no part; zero vectors do; only vectors of one length are compared;
of rows that share an id one is kept; ties go to the smaller id; positives with equal
products have equal negatives; a positive without a product over zero has a window only
at its own product (none below zero); products beyond the range of a long become its
nearest; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutline.llm import vectors as V
from cutline.session import materialize


@dataclass(frozen=True)
class Settings:
    block_rows: int = 4_096
    anchor_rows: int = 8_192
    #: Dimensions read between two looks at the bitmap.
    step: int = 8


class Columns:
    """A block of rows, read one dimension at a time."""

    def __init__(self, block: V.Block):
        self.block, self.least, self.most = block, block.m.min(1), block.m.max(1)
        self._exact: np.ndarray | None = None

    def scan(self, anchor: np.ndarray, alive: np.ndarray, wanted, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``alive`` that may be wanted and their exact products as longs.

        ``wanted(lower, upper)`` marks the intervals that are still of interest.
        """
        dims, cols = len(anchor), self.block.m
        low, high = self.least, self.most
        if not V.safe(float(np.abs(anchor).max(initial=0)), self.block.largest, dims):
            if self._exact is None:
                self._exact = V.integers(cols)
            anchor, cols = V.integers(anchor), self._exact
            low, high = V.integers(low), V.integers(high)
        order = np.argsort(-np.abs(anchor.astype(np.float64)), kind="stable")
        ends = np.stack([anchor * low, anchor * high])
        rest = [np.concatenate([np.cumsum(e[order][::-1])[::-1], np.zeros(1, e.dtype)]) for e in (ends.min(0), ends.max(0))]
        sums = np.zeros(len(alive), cols.dtype if cols.dtype == object else np.float64)
        whole = len(alive) == cols.shape[1]
        for first in range(0, dims, step):
            for d in order[first : first + step]:
                sums = sums + anchor[d] * (cols[d] if whole else cols[d][alive])
            done = min(first + step, dims)
            keep = wanted(V.clamped(sums + rest[0][done]), V.clamped(sums + rest[1][done]))
            if not keep.all():
                alive, sums, whole = alive[keep], sums[keep], False
                if not len(alive):
                    break
        return alive, V.clamped(sums)


class _Kept:
    """The best ``k`` rows under a key."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def floor(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else V.LEAST

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        top = V.best(scores, ids, self.k)
        self.scores, self.ids = scores[top], ids[top]


def _nth(values: np.ndarray, k: int) -> int:
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else V.LEAST


def _positives(block: dict[int, V.Block], k: int, step: int):
    """(anchor_id, id, score) of the best ``k`` rows of each anchor's label that a task sees."""

    def run(batches):
        held: dict[tuple[int, int], _Kept] = {}
        for rows in V.unpacked_rows(batches, columns=True):
            anchors = block.get(rows.m.shape[0])
            if anchors is None:
                continue
            columns, labels = Columns(rows), np.unique(rows.labels)
            for i in np.flatnonzero(np.isin(anchors.labels, labels)):
                kept = held.setdefault((rows.m.shape[0], int(i)), _Kept(k))
                alive = np.flatnonzero((rows.labels == anchors.labels[i]) & (rows.ids != anchors.ids[i]))
                floor = kept.floor

                def wanted(lower, upper, floor=floor):
                    return upper >= max(floor, _nth(lower, k))

                alive, scores = columns.scan(anchors.m[i], alive, wanted, step)
                if len(alive):
                    kept.add(scores, rows.ids[alive])
        for (dims, i), kept in held.items():
            yield pa.record_batch([pa.array(np.full(len(kept.ids), block[dims].ids[i])), pa.array(kept.ids), pa.array(kept.scores)], names=["anchor_id", "id", "score"])

    return run


def _negatives(block: dict[int, V.Block], windows: dict[int, list[int]], k: int, low: int, of: int, step: int):
    """(anchor_id, positive_score, id, score) of the best ``k`` rows of other labels in each window that a task sees."""

    def run(batches):
        held: dict[tuple[int, int], list[_Kept]] = {}
        bounds = {a: (np.array([-((-low * p) // of) for p in ps], object), np.array(ps, object)) for a, ps in windows.items()}
        bounds = {a: (V.clamped(lo), V.clamped(hi)) for a, (lo, hi) in bounds.items()}
        for rows in V.unpacked_rows(batches, columns=True):
            anchors = block.get(rows.m.shape[0])
            if anchors is None:
                continue
            columns, labels = Columns(rows), np.unique(rows.labels)
            for i in range(len(anchors.ids)):
                anchor = int(anchors.ids[i])
                if anchor not in bounds or (len(labels) == 1 and labels[0] == anchors.labels[i]):
                    continue
                floors, roofs = bounds[anchor]
                kept = held.setdefault((rows.m.shape[0], i), [_Kept(k) for _ in roofs])
                alive = np.flatnonzero(rows.labels != anchors.labels[i])
                floors = np.maximum(floors, [one.floor for one in kept])

                def wanted(lower, upper, floors=floors, roofs=roofs):
                    keep = np.zeros(len(lower), bool)
                    for floor, roof in zip(floors, roofs):
                        inside = (lower >= floor) & (upper <= roof)
                        if np.count_nonzero(inside) >= k:
                            floor = max(floor, _nth(lower[inside], k))
                        keep |= (upper >= floor) & (lower <= roof)
                    return keep

                alive, scores = columns.scan(anchors.m[i], alive, wanted, step)
                for floor, roof, one in zip(floors, roofs, kept):
                    inside = (scores >= floor) & (scores <= roof)
                    if inside.any():
                        one.add(scores[inside], rows.ids[alive[inside]])
        for (dims, i), kept in held.items():
            anchor = int(block[dims].ids[i])
            for p, one in zip(windows[anchor], kept):
                n = len(one.ids)
                yield pa.record_batch([pa.array(np.full(n, anchor)), pa.array(np.full(n, p, np.int64)), pa.array(one.ids), pa.array(one.scores)], names=["anchor_id", "positive_score", "id", "score"])

    return run


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: float = 256.0,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", settings: Settings = Settings(),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score by products of floor(scale * x).

    A negative's product times window[1] is at least the positive's times window[0], and
    at most the positive's own. ``is_anchor`` is a test of ``id``.
    """
    spark = vectors.sparkSession
    rows = materialize(V.whole(vectors.where(F.col(label_col).isNotNull()), scale, id_col, vec_col, label_col), "whole")
    order = ["dims", "label", "id"]
    stored = materialize(V.packed(rows.repartitionByRange(*order).sortWithinPartitions(*order), settings.block_rows, columns=True), "columns")
    parts = []
    for block in V.query_blocks(V.packed(rows.where(is_anchor), settings.block_rows), settings.anchor_rows):
        found = stored.mapInArrow(_positives(block, positives, settings.step), "anchor_id long, id long, score long")
        pairs = materialize(_first(found, ["anchor_id"], positives).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        wanted = pairs.groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("scores")).where(F.exists("scores", lambda s: s >= 0))
        windows = {r.anchor_id: [s for s in r.scores if s >= 0] for r in wanted.collect()}  # a row for each anchor of the block at most
        found = stored.mapInArrow(_negatives(block, windows, negatives, *window, settings.step), "anchor_id long, positive_score long, id long, score long")
        best = _first(found, ["anchor_id", "positive_score"], negatives).select("anchor_id", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        parts.append(materialize(pairs.join(best, ["anchor_id", "positive_score"]), "negatives"))
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(columns)
