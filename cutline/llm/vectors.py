"""Vectors as whole numbers, in blocks of bounded size, and query sets in blocks.

``whole`` turns each vector into floor(scale * x). ``packed`` writes runs of rows as
one row each: ids, labels and a matrix of the narrowest integers that hold it. Both
work on bounded slices. ``query_blocks`` hands the queries to the driver a bounded
block at a time; each block then meets all stored blocks of rows in one job.

Inner products are exact: in doubles while no sum can leave 2**53, else in Python's
integers, clamped to the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST = -(1 << 63), (1 << 63) - 1
_KIND = {2: np.dtype("<i2"), 4: np.dtype("<i4"), 8: np.dtype("<f8")}
_ROWS = "id long, label int, dims int, norm double, width int, vec binary"
_BLOCKS = "dims int, count int, low int, high int, longest double, width int, ids binary, labels binary, norms binary, vecs binary"


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    size = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _width(largest: np.ndarray) -> np.ndarray:
    return np.where(largest < 1 << 15, 2, np.where(largest < 1 << 31, 4, 8))


def _scaled(scale: float):
    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column("id")), pc.is_valid(batch.column("vec"))))
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                vecs = part.column("vec")
                length = pc.list_value_length(vecs).to_numpy().astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(length)])
                with np.errstate(over="ignore"):
                    x = np.floor(scale * vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                odd = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
                fit = odd[ends[1:]] == odd[ends[:-1]]
                for dims in np.unique(length[fit]):
                    rows = np.flatnonzero(fit & (length == dims))
                    m = x[ends[rows][:, None] + np.arange(dims)] + 0.0  # no negative zero
                    width = _width(np.abs(m).max(1, initial=0))
                    with np.errstate(over="ignore"):
                        norm = np.sqrt((m * m).sum(1))
                    for w in np.unique(width):
                        at = np.flatnonzero(width == w)
                        taken = part.take(pa.array(rows[at]))
                        same = lambda v: pa.array(np.full(len(at), v), pa.int32())
                        yield pa.record_batch(
                            [taken.column("id"), taken.column("label"), same(dims), pa.array(norm[at]), same(w), _binary(m[at].astype(_KIND[int(w)]))],
                            names=["id", "label", "dims", "norm", "width", "vec"],
                        )

    return run


def whole(vectors: DataFrame, scale: float, id_col: str, vec_col: str, label_col: str | None = None) -> DataFrame:
    """id, label, dims, norm, width, vec: one row for each id with a usable vector.

    Vectors that are null, or hold a null or a component that isn't finite (also once
    scaled), and rows without an id are left out. Of several rows with one id the
    least label and vector is kept.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label_col else F.lit(None)).cast("int").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    ids = rows.agg(F.count("id").alias("rows"), F.count_distinct("id").alias("ids")).first()
    made = rows.mapInArrow(_scaled(scale), _ROWS)
    if ids.rows == ids.ids:
        return made
    return made.groupBy("id").agg(F.min(F.struct("label", "dims", "width", "vec", "norm")).alias("r")).select("id", "r.label", "r.dims", "r.norm", "r.width", "r.vec")


@dataclass(frozen=True)
class Block:
    """Some vectors of one length."""

    ids: np.ndarray
    labels: np.ndarray
    norms: np.ndarray
    m: np.ndarray  # rows by dims, doubles

    @property
    def largest(self) -> float:
        return float(np.abs(self.m).max(initial=0))


def packed(rows: DataFrame, block_rows: int, columns: bool = False) -> DataFrame:
    """Runs of up to ``block_rows`` rows of one length, in the order of the rows. ``columns`` stores matrices dimension by dimension."""

    def emit(dims: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        widths = t.column("width").to_numpy()
        width = int(widths.max())
        m = np.empty((len(widths), dims), _KIND[width])
        vecs = t.column("vec").combine_chunks()
        for w in np.unique(widths):
            at = np.flatnonzero(widths == w)
            m[at] = np.frombuffer(b"".join(vecs.take(pa.array(at)).to_pylist()), _KIND[int(w)]).reshape(len(at), dims)
        norms = t.column("norm").to_numpy()
        labels = np.array(t.column("label").fill_null(0).to_numpy(), np.int32)
        one = lambda v, kind: pa.array([v], kind)
        return pa.record_batch(
            [one(dims, pa.int32()), one(len(m), pa.int32()), one(int(labels.min()), pa.int32()), one(int(labels.max()), pa.int32()), one(float(norms.max()), pa.float64()), one(width, pa.int32()),
             one(t.column("id").to_numpy().astype("<i8").tobytes(), pa.binary()), one(labels.astype("<i4").tobytes(), pa.binary()), one(norms.astype("<f8").tobytes(), pa.binary()),
             one((m.T if columns else m).tobytes(), pa.binary())],
            names=[c.split()[0] for c in _BLOCKS.split(", ")],
        )

    def run(batches):
        held: dict[int, list[pa.RecordBatch]] = {}
        size = 0
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for first in range(0, batch.num_rows, block_rows):
                part = dims[first : first + block_rows]
                for d in np.unique(part):
                    of_d = batch.take(pa.array(first + np.flatnonzero(part == d)))
                    while of_d.num_rows:
                        have = sum(b.num_rows for b in held.get(int(d), []))
                        taken = of_d.slice(0, block_rows - have)
                        held.setdefault(int(d), []).append(taken)
                        size += taken.num_rows
                        of_d = of_d.slice(taken.num_rows)
                        if have + taken.num_rows == block_rows:
                            yield emit(int(d), held.pop(int(d)))
                            size -= block_rows
                if size > 4 * block_rows:
                    for d in list(held):
                        yield emit(d, held.pop(d))
                    size = 0
        for d in list(held):
            yield emit(d, held.pop(d))

    return rows.select("id", "label", "dims", "norm", "width", "vec").mapInArrow(run, _BLOCKS)


def unpacked(row: dict, columns: bool = False) -> Block:
    """A stored block; with ``columns`` its matrix has dims by rows."""
    shape = (row["dims"], row["count"]) if columns else (row["count"], row["dims"])
    m = np.frombuffer(row["vecs"], _KIND[row["width"]]).reshape(shape).astype(np.float64)
    return Block(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i4"), np.frombuffer(row["norms"], "<f8"), m)


def unpacked_rows(batches, columns: bool = False) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield unpacked({name: batch.column(name)[i].as_py() for name in batch.schema.names}, columns)


def query_blocks(packed_queries: DataFrame, most: int) -> Iterator[dict[int, Block]]:
    """The queries, by length, about ``most`` at a time (one packed row more at most)."""
    held: list[dict] = []
    count = 0

    def joined() -> dict[int, Block]:
        out = {}
        for d in {r["dims"] for r in held}:
            parts = [unpacked(r) for r in held if r["dims"] == d]
            out[d] = Block(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("ids", "labels", "norms", "m")))
        return out

    for row in packed_queries.toLocalIterator():
        held.append(row.asDict())
        count += row["count"]
        if count >= most:
            yield joined()
            held, count = [], 0
    if held:
        yield joined()


def safe(a: float, b: float, dims: int) -> bool:
    """Whether all sums of ``dims`` products of components up to ``a`` and ``b`` are exact in doubles."""
    return a * b * max(dims, 1) < 2.0**53


def integers(m: np.ndarray) -> np.ndarray:
    """Whole doubles as Python's integers."""
    return np.frompyfunc(int, 1, 1)(m) if m.size else m.astype(object)


def clamped(x: np.ndarray) -> np.ndarray:
    """Scores as longs, those out of range as the nearest long."""
    if x.dtype != object:
        return x.astype(np.int64)
    return np.array([min(max(int(v), LEAST), MOST) for v in x.ravel()], np.int64).reshape(x.shape)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``q`` and ``v`` as longs."""
    if safe(float(np.abs(q).max(initial=0)), float(np.abs(v).max(initial=0)), q.shape[1]):
        return clamped(q @ v.T)
    if not q.shape[1]:
        return np.zeros((len(q), len(v)), np.int64)
    return clamped(integers(q) @ integers(v).T)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids."""
    if len(scores) > 8 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        held = np.flatnonzero(scores >= least)
        return held[_order(scores[held], ids[held])[:k]]
    return _order(scores, ids)[:k]


def _order(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, ~scores))  # the complement reverses longs without overflow
