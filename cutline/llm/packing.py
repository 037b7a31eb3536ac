"""Packing of token pieces into sequences of equal length, by a configuration program.

A configuration is a multiset of piece lengths that fits a sequence. The linear
program asks for the fewest configurations that hold the length histogram. It is
solved by multiplicative weights: every round prices a length by how far it is
covered, finds the dearest configuration by a knapsack over the capacity, and
adds it. The solution is rounded down to whole multiplicities that the histogram
allows; what is left is a new histogram, solved again while that helps, and at
last filled by best fit. Should best fit alone need fewer sequences (where pieces over
half a sequence prevail), its plan is taken. All this works on at most ``size`` counts, whatever
the number of documents.

The pieces themselves never meet: each gets its rank among those of its length (the
count in earlier tasks and in its own before it), and the plan says for each range of
ranks which sequences and offset they take.

Edge cases: a null or empty text is its end id alone; documents over ``size`` ids
are cut so that only their first piece is shorter; repeated rows and null ids are
packed like any others; an empty table gives no rows; other columns are not read. With
``added`` the strings of added tokens in a text become those tokens, as in a plain library call.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutline.llm.batches import ENCODE_BYTES, slices
from cutline.llm.vocab import library
from cutline.session import materialize

#: Rounds of one phase at most, steps in which the bound is covered, phases, learning rate, worth of long pieces.
ROUNDS, STEPS, PHASES, ETA, LONG = 1024, 256, 3, 0.0005, 0.1


def knapsack(prices: np.ndarray, lengths: np.ndarray, size: int) -> list[int]:
    """The lengths (with repeats) of the dearest multiset that fits ``size``."""
    best, took = np.zeros(size + 1), np.full(size + 1, -1)
    for room in range(1, size + 1):
        n = np.searchsorted(lengths, room, side="right")
        if n:
            value = prices[:n] + best[room - lengths[:n]]
            k = int(value.argmax())
            best[room], took[room] = value[k], k
        if best[room - 1] > best[room]:
            best[room], took[room] = best[room - 1], -1
    out, room = [], size
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            out.append(int(lengths[took[room]]))
            room -= out[-1]
    return out


def weighted(counts: np.ndarray, size: int, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], float]]:
    """Configurations and fractional multiplicities that nearly cover ``counts`` (by length).

    A length's price is the length times its weight, which falls as it is covered and ends
    when it is, and a little more for long pieces, which fit fewest places: a full sequence is
    worth most, of full ones that with the longest pieces, of these that with the least covered.
    """
    lengths = np.flatnonzero(counts)
    n = counts[lengths].astype(float)
    step = max(1.0, float((lengths * n).sum()) / size / STEPS)
    cover, found = np.zeros(len(lengths)), {}
    for _ in range(rounds):
        open_ = np.flatnonzero(cover < 1 - 1e-9)
        if not len(open_):
            break
        prices = (lengths + LONG * lengths**2 / size) * np.exp(-ETA * cover)
        chosen = tuple(sorted(knapsack(prices[open_], lengths[open_], size), reverse=True))
        kinds, times = np.unique(chosen, return_counts=True)
        at = np.searchsorted(lengths, kinds)
        share = min(step, max(1.0, float(((1 - cover[at]) * n[at] / times).min())))
        found[chosen] = found.get(chosen, 0.0) + share
        cover[at] += share * times / n[at]
    return sorted(found.items(), key=lambda x: (-sum(x[0]), -x[1], x[0]))


def best_fit(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first into the fullest sequences with room, like ones at once: at most two groups for each length."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            room = min((r for r in groups if r >= length), default=None)
            if room is None:
                each = size // length
                if left >= each:
                    groups.setdefault(size - each * length, []).append(((length,) * each, left // each))
                left %= each
                if left:
                    groups.setdefault(size - left * length, []).append(((length,) * left, 1))
                break
            chosen, many = groups[room].pop()
            used = min(left, many)
            if many > used:
                groups[room].append((chosen, many - used))
            if not groups[room]:
                del groups[room]
            groups.setdefault(room - length, []).append(((*chosen, length), used))
            left -= used
    return [x for held in groups.values() for x in held]


def plan(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and whole multiplicities that hold ``counts[length]`` pieces of each length, exactly."""
    left, out = counts.astype(np.int64).copy(), []
    for phase in range(PHASES):
        total = int(left.sum())
        if total < 64:
            break
        for chosen, share in weighted(left, size):
            if sum(chosen) < size - phase:  # wasteful ones wait for the best fit
                continue
            kinds, times = np.unique(chosen, return_counts=True)
            many = int(min(max(1, round(share)), (left[kinds] // times).min()))
            if many > 0:
                left[kinds] -= many * times
                out.append((chosen, many))
        if left.sum() > 0.9 * total:
            break
    out, plain = out + best_fit(left, size), best_fit(counts, size)
    return min(out, plain, key=lambda made: sum(many for _, many in made))


def pieces(docs: DataFrame, path: str, kind: str, end: int, size: int, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, with the task and the rank among its pieces of that length."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]

    def run(batches):
        held, task, seen = library(path, kind, added), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for row, stop, raw, at in slices(batch.column("text"), ENCODE_BYTES):
                ids, first = held.with_end(raw, at, end)
                total = np.diff(first)
                parts = -(-total // size)
                short = total - (parts - 1) * size
                doc = np.repeat(np.arange(stop - row), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                length = np.where(piece == 0, short[doc], size)
                start = np.where(piece == 0, 0, short[doc] + (piece - 1) * size)
                begin = first[:-1][doc] + start
                data = ids.astype("<u4")
                crc = [zlib.crc32(data[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
                order = np.argsort(length, kind="stable")
                edge = np.searchsorted(length[order], length[order])
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - edge
                rank += seen[length]
                seen += np.bincount(length, minlength=size + 1)
                columns = [batch.column("doc_id").slice(row, stop - row).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(rank)]
                yield pa.record_batch(columns, names=names)

    kind_ = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind_}, piece int, start long, length long, ids_crc32 long, task int, rank long")


def packed(docs: DataFrame, path: str, kind: str = "byte", end: int = 2, size: int = 1024, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = materialize(pieces(docs, path, kind, end, size, added), "pieces")
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    by_task = materialize(by_task.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"), "n"), "counts")
    counts = np.zeros(size + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length
        counts[row.length] = row.n
    used, sequence = np.zeros(size + 1, np.int64), 0
    slots: dict[int, list[tuple[int, int, int]]] = {}
    for chosen, many in plan(counts, size):
        offset = 0
        for length in chosen:
            slots.setdefault(length, []).append((int(used[length]), sequence, offset))
            used[length] += many
            offset += length
        sequence += many
    arrays = {k: np.array(v, np.int64) for k, v in slots.items()}

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("place").to_numpy()
            sequence_id, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for kind_ in np.unique(length):
                rows = np.flatnonzero(length == kind_)
                slot = arrays[int(kind_)]
                k = np.searchsorted(slot[:, 0], rank[rows], side="right") - 1
                sequence_id[rows], offset[rows] = slot[k, 1] + rank[rows] - slot[k, 0], slot[k, 2]
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(sequence_id), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = cut.join(by_task.select("task", "length", "before"), ["task", "length"]).select(*kept, (F.col("rank") + F.col("before")).alias("place"))
    kind_ = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(run, f"doc_id {kind_}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
