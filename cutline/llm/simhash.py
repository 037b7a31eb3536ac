"""Near copies by SimHash, found by meeting in the middle of a Hamming ball.

Two fingerprints of at most ``radius`` differing bits have a common variant that
differs from each in at most half of them. Every distinct fingerprint therefore
emits all variants within half the radius, and fingerprints that share a variant
are linked. The variants of one fingerprint with the same first bits travel
together: a row holds the prefix and the fingerprint, and the task that owns the
prefix writes the variants out. That shuffles 137 rows instead of 2081 and lets
the same variants meet.

All fingerprints at one variant are within the radius of each other, so they are
linked to the least of them, never in all pairs; each link is checked by its
distance. With an odd radius the variants reach to its greater half, and the least is
taken among the members within the lesser half. A task reduces its links to a spanning forest, and the forests are
joined to components.

A prefix that gathers over ``hot_rows`` rows is split by the variants' next
bits, so that no task holds a whole crowd of like fingerprints.

Edge cases: a null or empty text has fingerprint zero, which links like any
other; exact copies share a fingerprint and meet before any variant is made;
a row with a null id is linked, but is nobody's least id unless all are null;
other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.llm.batches import ASCII_LOWER, by_slice, ranges, words
from cutline.llm.components import components
from cutline.session import materialize

PREFIX, NEXT = 16, 8
CHUNK = 1 << 20


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each whole text's word shingles, as a signed long."""

    def work(raw, at, _):
        raw = ASCII_LOWER[raw]
        start, end, first = words(raw, at)
        length = end - start
        out = np.zeros(len(at) - 1, np.uint64)
        joined = np.full(int(length.sum()) + len(start), 0x20, np.uint8)  # each word with one blank behind it
        begin = np.cumsum(length + 1) - (length + 1)
        joined[ranges(begin, length)] = raw[ranges(start, length)]
        stop = begin + length
        data, count = joined.tobytes(), np.diff(first)
        shingles = np.where(count > 0, np.maximum(1, count - size + 1), 0)
        head = ranges(first[:-1], shingles)
        tail = np.minimum(head + size, np.repeat(first[1:], shingles)) - 1
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(data[a:b], seed) for a, b in zip(begin[head].tolist(), stop[tail].tolist())), np.uint64, len(head))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ends = np.append(0, np.cumsum(shingles))
        some = np.flatnonzero(shingles)
        if len(some):
            ones = np.add.reduceat(bits, ends[:-1][some], axis=0, dtype=np.int64)
            out[some] = np.packbits(2 * ones > shingles[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
        return {"fp": out.view(np.int64)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(by_slice({"fp": pa.int64()}, work), f"doc_id {kind}, fp long")


def _masks(bits: int, most: int) -> np.ndarray:
    """All words of so many bits with at most ``most`` ones."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.uint64)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the least node that it reaches; loops are left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        lx, ly = label[x], label[y]
        if np.array_equal(lx, ly):
            break
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
        while not np.array_equal(label, label[label]):
            label = label[label]
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _linker(radius: int):
    """Reads rows (group, fp, bits, left) sorted by group; gives links between fingerprints that share a variant."""
    tables = {(bits, left): _masks(64 - bits, left) for bits in (PREFIX, PREFIX + NEXT) for left in range((radius + 1) // 2 + 1)}

    def stars(fps, flips, bits, left, parts, part):
        """Links of one run of whole groups, or of the part of its variants with the given remainder."""
        variants, owners = [], []
        for b in np.unique(bits):
            for k in np.unique(left[bits == b]):
                rows = np.flatnonzero((bits == b) & (left == k))
                table = tables[int(b), int(k)]
                step = max(1, 4 * CHUNK // len(table))
                for i in range(0, len(rows), step):
                    v = ((fps[rows[i : i + step]] ^ flips[rows[i : i + step]])[:, None] ^ table[None, :]).ravel()
                    own = np.repeat(rows[i : i + step], len(table))
                    if parts > 1:
                        with np.errstate(over="ignore"):
                            mine = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts) == part
                        v, own = v[mine], own[mine]
                    variants.append(v)
                    owners.append(own)
        v, own = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(v, kind="stable")
        v, who = v[order], fps[own[order]]
        same = v[1:] == v[:-1]
        if not same.any():
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        lead = np.flatnonzero(np.append(True, ~same))
        size = np.diff(np.append(lead, len(v)))
        lead, size = lead[size > 1], size[size > 1]
        inner = who[ranges(lead, size)]
        if radius % 2:  # only members within the lesser half are within the radius of all others
            core = np.bitwise_count(inner ^ v[ranges(lead, size)]) <= radius // 2
            some = np.repeat(np.logical_or.reduceat(core, np.cumsum(size) - size), size)
            inner, core, size = inner[some], core[some], size[some[np.cumsum(size) - size]]
            if not len(size):
                return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            middle = np.where(core, inner, np.uint64(2**64 - 1))
        else:
            middle = inner
        least = np.repeat(np.minimum.reduceat(middle, np.cumsum(size) - size), size)
        near = np.bitwise_count(inner ^ least) <= radius
        return _forest(inner[near], least[near])

    def run(batches):
        held, kept_a, kept_b = [], np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def settle(rows):
            nonlocal kept_a, kept_b
            group, fps, flips, bits, left = rows
            cost = np.select([(bits == b) & (left == k) for b, k in tables], [len(t) for t in tables.values()])
            edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            total = np.append(np.add.reduceat(cost, edge), 0)
            at = 0
            while at < len(edge):
                stop, sum_ = at + 1, total[at]
                while stop < len(edge) and sum_ + total[stop] <= CHUNK:
                    sum_ += total[stop]
                    stop += 1
                a, b = edge[at], edge[stop] if stop < len(edge) else len(group)
                parts = max(1, -(-int(sum_) // (4 * CHUNK)))
                for part in range(parts):
                    x, y = stars(fps[a:b], flips[a:b], bits[a:b], left[a:b], parts, part)
                    kept_a, kept_b = np.append(kept_a, x), np.append(kept_b, y)
                    if len(kept_a) > CHUNK:
                        kept_a, kept_b = _forest(kept_a, kept_b)
                at = stop

        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("group", "fp", "flip", "bits", "left")]
            columns[1], columns[2] = columns[1].view(np.uint64), columns[2].view(np.uint64)
            held = [np.concatenate(x) for x in zip(held, columns)] if held else columns
            ends = np.flatnonzero(held[0][1:] != held[0][:-1])
            if len(ends) and len(held[0]) > 20_000:  # all but the last group are whole
                cut = ends[-1] + 1
                settle([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held and len(held[0]):
            settle(held)
        if len(kept_a):
            kept_a, kept_b = _forest(kept_a, kept_b)
            yield pa.record_batch([pa.array(kept_a.view(np.int64)), pa.array(kept_b.view(np.int64))], names=["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = 4, hot_rows: int = 20_000) -> DataFrame:
    """Links (a, b) from fingerprints ``fp`` to others that they reach over steps within the radius.

    Every step was checked by its distance; the links of one task are a forest over its steps.
    """
    half = (radius + 1) // 2
    if half > 2:
        raise ValueError("variants within more than two bits are not emitted")
    lit = lambda masks: F.array(*[F.lit(int(m)).cast("long") for m in masks])
    first, second = lit(_masks(PREFIX, half)), lit(_masks(NEXT, half))
    prefix = F.shiftrightunsigned("fp", 64 - PREFIX)
    near = distinct.select("fp", prefix.alias("own"))
    # how many fingerprints meet at each prefix: from the at most 2 ** PREFIX counts of their own prefixes
    met = near.groupBy("own").count().withColumn("mask", F.explode(first)).groupBy(F.col("own").bitwiseXOR(F.col("mask")).alias("prefix")).agg(F.sum("count").alias("rows"))
    crowded = materialize(met.where(F.col("rows") > hot_rows).select("prefix"), "prefixes").withColumn("hot", F.lit(True))
    near = near.withColumn("mask", F.explode(first)).withColumn("prefix", F.col("own").bitwiseXOR(F.col("mask"))).join(crowded, "prefix", "left")
    near = near.withColumn("left", F.lit(half) - F.bit_count("mask"))
    near = near.withColumn("next", F.explode(F.when(F.col("hot"), F.filter(second, lambda m: F.bit_count(m) <= F.col("left"))).otherwise(lit([0]))))
    flip = F.shiftleft("mask", 64 - PREFIX).bitwiseOR(F.shiftleft("next", 64 - PREFIX - NEXT))
    longer = -1 - F.shiftrightunsigned(F.col("fp").bitwiseXOR(flip), 64 - PREFIX - NEXT)
    rows = near.select(
        F.when(F.col("hot"), longer).otherwise(F.col("prefix")).alias("group"), "fp", flip.alias("flip"),
        F.when(F.col("hot"), PREFIX + NEXT).otherwise(PREFIX).alias("bits"), (F.col("left") - F.bit_count("next")).cast("int").alias("left"),
    )
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(_linker(radius), "a long, b long").distinct()


def near_copies(docs: DataFrame, radius: int = 4, size: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links."""
    marked = materialize(fingerprints(docs, size), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    tree = materialize(components(links(distinct, radius)), "components")
    roots = distinct.join(tree, distinct.fp == tree.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = materialize(roots.join(ids, "root").select("fp", "component_id"), "roots")
    return marked.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
