"""Repeated passages by the common-prefix interval tree of a sampled suffix array.

The width is 100 bytes: two places repeat each other if their next 100 bytes
are equal. Three steps find all such places without ever sorting every suffix.

1. *Anchors.* Each 100-byte string is led by the least of the hashed ``GRAM``-byte
   strings inside it, which is the same wherever the string occurs. Neighbouring
   starts share a leader, so a text becomes a row for every forty bytes or so: the
   leader's hash, its place, the run of starts it leads, and a hash of all bytes
   these starts cover. Anchors of equal hash and bytes within one slice of rows are
   compared on the spot; only the earliest travels.
2. *Groups.* Anchors meet by their hash. Equal bytes are one maximal repeat with all
   its occurrences. Where bytes differ, the texts around the anchors are fetched.
3. *Interval tree.* The right contexts of the anchors of one hash are sorted: a
   suffix array sampled at the anchors. A stack scan over its common prefixes gives
   the intervals of the tree. For each interval the left contexts are scanned the
   same way: a node whose members' left extensions differ is a maximal repeat. It is
   held as a range of ranks in each of the two orders, which gives all its occurrences
   without listing them once for each node they lie in. Every member but the earliest
   repeats it; what is cut is one span a member, from the widest such nodes.

A hash with over ``hot_rows`` anchors is taken out of step 3: each 100-byte string
around such anchors becomes a row with its 128-bit hash, slices send the earliest
of each, and equal hashes meet. So no task holds a crowd of like passages.

Edge cases: null and empty texts have no bytes and nothing is removed; a text
under 100 bytes never repeats; where ids repeat or are null, rows are first
numbered in the order (doc_id, nulls last, text), and equal rows are taken one
after the other, so that the first one stays; other columns are kept or not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.llm.batches import by_slice, ranges, slices
from cutline.llm.rows import numbered
from cutline.session import materialize

WIDTH, GRAM = 100, 24
SEGMENT = 2 << 20
_PLACE = np.uint64((1 << 24) - 1)


def _table(seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(bytes([i]), seed) for i in range(256)], np.uint64)


_BYTE, _OTHER = _table(1), _table(2)
_BASE, _OTHER_BASE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 18), base)
        steps[0] = 1
        held = _POWERS[int(base)] = np.multiply.accumulate(steps)
    return held[:n]


class Rolling:
    """Hashes of any substring of ``raw`` from sums of powers; the same bytes hash alike wherever they lie."""

    def __init__(self, raw: np.ndarray, table: np.ndarray, base: np.uint64):
        self.back = _powers(np.uint64(pow(int(base), -1, 1 << 64)), len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(table[raw] * _powers(base, len(raw)), out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.back[start]

    def each(self, size: int) -> np.ndarray:
        """All substrings of the given size."""
        return (self.sums[size:] - self.sums[:-size]) * self.back[: len(self.sums) - size]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def anchors(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, place, first start, last start, hash of the leader, hash of the covered bytes), for texts of up to 16 MB in all.

    Places and starts count within their text.
    """
    if len(raw) < WIDTH:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    rolling = Rolling(raw, _BYTE, _BASE)
    grams = rolling.each(GRAM)
    with np.errstate(over="ignore"):
        mixed = (grams ^ (grams >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    leader = (_least((mixed & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), WIDTH - GRAM + 1) & _PLACE).astype(np.int64)
    starts = ranges(at[:-1], np.maximum(np.diff(at) - WIDTH + 1, 0))
    leads = leader[starts]
    edge = np.flatnonzero(np.append(True, (leads[1:] != leads[:-1]) | (starts[1:] != starts[:-1] + 1)))[: len(starts)]
    last = starts[np.append(edge[1:], len(starts))[: len(edge)] - 1]
    first, place = starts[edge], leads[edge]
    covered = Rolling(raw, _OTHER, _OTHER_BASE).of(first, last + WIDTH)
    with np.errstate(over="ignore"):
        covered = (covered ^ (((place - first).astype(np.uint64) << np.uint64(8)) | (last - first).astype(np.uint64))) * np.uint64(0xE7037ED1A0B428DB)
    text = np.searchsorted(at, first, side="right") - 1
    return text, place - at[text], first - at[text], last - at[text], mixed[place], covered ^ (covered >> np.uint64(29))


def _segments(raw: np.ndarray, at: np.ndarray):
    """Texts as parts of bounded size that overlap by one byte less than the width: (first byte in its text, bytes, beginnings)."""
    if len(raw) <= SEGMENT:
        yield 0, raw, at
        return
    for i in range(len(at) - 1):  # slices hold one text where they are this long
        text = raw[at[i] : at[i + 1]]
        for begin in range(0, max(1, len(text) - WIDTH + 1), SEGMENT):
            part = text[begin : begin + SEGMENT + WIDTH - 1]
            yield begin, part, np.array([0, len(part)])


def _ordered(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by the keys, and where (in that order) the first two differ from the row before."""
    order = np.lexsort(keys[::-1])
    a, b = keys[0][order], keys[1][order]
    return order, np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]


_ANCHOR = "key long, covered long, doc long, place long, first int, last int, state byte"
#: An anchor that waits for others, one that stands for several of its slice, one that repeats an earlier anchor of its slice.
ALONE, SEVERAL, REPEATS = 0, 1, 2


def _anchor_rows(batches):
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for row, stop, raw, at in slices(batch.column("text")):
            for begin, part, ends in _segments(raw, at):
                text, place, first, last, key, covered = anchors(part, ends)
                if not len(text):
                    continue
                doc, place = ids[row:stop][text], place + begin
                order, fresh = _ordered(key, covered, doc, place)
                count = np.diff(np.append(np.flatnonzero(fresh), len(order)))
                state = np.where(fresh, np.where(np.repeat(count, count) > 1, SEVERAL, ALONE), REPEATS).astype(np.int8)
                doc, place = doc[order], place[order]
                yield pa.record_batch(
                    [pa.array(key[order].view(np.int64)), pa.array(covered[order].view(np.int64)), pa.array(doc, pa.int64()), pa.array(place),
                     pa.array((place - (first[order] + begin)).astype(np.int32)), pa.array((last[order] - first[order]).astype(np.int32)), pa.array(state)],
                    names=["key", "covered", "doc", "place", "first", "last", "state"],
                )


_MET = "repeat long, doc long, start long, size int, leads boolean, key long, place long, first int, last int, hot boolean"
_MET_NAMES = ["repeat", "doc", "start", "size", "leads", "key", "place", "first", "last", "hot"]


def _meet(hot_rows: int):
    """Reads anchors sorted by (group, key, covered, doc, place). Gives occurrences of repeats, and anchors whose bytes must be compared."""

    def settle(rows, hot):
        group, key, covered, doc, place, first, last, state = rows
        start, size = place - first, last + WIDTH
        edge = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]) | (covered[1:] != covered[:-1]))
        run = np.cumsum(edge) - 1
        count = np.bincount(run)
        head = np.flatnonzero(edge)
        key_edge = np.append(True, (group[head][1:] != group[head][:-1]) | (key[head][1:] != key[head][:-1]))
        contents = np.bincount(np.cumsum(key_edge) - 1)
        differ = np.repeat(contents, contents) > 1  # of each run: other bytes have the same key
        repeat = key ^ covered
        known = (state == REPEATS) | (count[run] > 1) | (state == SEVERAL)
        leads = edge & (state != REPEATS)
        compare = np.zeros(len(key), bool)
        compare[head] = differ
        compare &= state != REPEATS
        if hot:  # its strings are compared one by one; what equals an earlier anchor here needs no comparison
            compare = edge & (state != REPEATS)
            known = (state == REPEATS) | (state == SEVERAL) | ~edge
        out = known | compare
        size_ = np.where(known, size, 0).astype(np.int32)
        return pa.record_batch(
            [pa.array(x[out]) for x in (repeat, doc, start, size_, leads, key, place, first, last)] + [pa.array((compare & hot)[out] if hot else np.zeros(out.sum(), bool))],
            names=_MET_NAMES,
        ), compare[out]

    def run(batches):
        held, hot_key = None, None

        def give(rows, hot):
            batch, compare = settle(rows, hot)
            key = pa.array(np.where(compare, batch.column("key").to_numpy(), 0), pa.int64(), mask=~compare)
            return batch.set_column(5, "key", key)

        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("group", "key", "covered", "doc", "place", "first", "last", "state")]
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            while len(held[0]):
                if hot_key is not None:  # the rest of a crowded key
                    cut = int(np.searchsorted(held[0] != hot_key, True)) if held[0][-1] != hot_key else len(held[0])
                    if cut:
                        yield give([x[:cut] for x in held], True)
                    held = [x[cut:] for x in held]
                    if len(held[0]):
                        hot_key = None
                    continue
                ends = np.flatnonzero(held[0][1:] != held[0][:-1])
                begins = np.append(0, ends + 1)
                sizes = np.diff(np.append(begins, len(held[0])))
                crowd = np.flatnonzero(sizes > hot_rows)
                if len(crowd):
                    cut = begins[crowd[0]]
                    hot_key = held[0][cut]
                elif len(ends) and len(held[0]) > 50_000:
                    cut = begins[-1]
                else:
                    break
                if cut:
                    yield give([x[:cut] for x in held], False)
                held = [x[cut:] for x in held]
                if hot_key is None:
                    break
        if held and len(held[0]):
            yield give(held, hot_key is not None)

    return run


_AROUND = "group long, other long, doc long, place long, lefts binary, rights binary, state byte"
#: A string of a crowded key that waits for others, one that repeats an earlier one of its batch; an anchor with its bytes.
STRING, AGAIN, ANCHOR = 0, 1, 2


def _around(batches):
    """The bytes before and after each anchor, or the hashed strings around anchors of a crowded key."""
    names = ["group", "other", "doc", "place", "lefts", "rights", "state"]

    def hashed(strings):
        strings.sort()
        mask, n = (1 << 64) - 1, len(strings)
        high = np.array([h >> 64 for h, _, _ in strings], np.uint64).view(np.int64)
        low = np.array([h & mask for h, _, _ in strings], np.uint64).view(np.int64)
        again = np.append(False, (high[1:] == high[:-1]) & (low[1:] == low[:-1]))
        none = pa.nulls(n, pa.binary())
        return pa.record_batch([pa.array(high), pa.array(low), pa.array([d for _, d, _ in strings], pa.int64()), pa.array([s for _, _, s in strings], pa.int64()), none, none, pa.array(np.where(again, AGAIN, STRING).astype(np.int8))], names=names)

    for batch in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
        strings = []
        for doc, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("found").to_pylist()):
            out = []
            for x in found:
                place, begin, stop = x["place"], x["place"] - x["first"], x["place"] - x["first"] + x["last"] + WIDTH
                if x["hot"]:
                    for s in range(begin, begin + x["last"] + 1):
                        h = xxhash.xxh3_128_intdigest(text[s : s + WIDTH])
                        strings.append((h, doc, s))
                else:
                    out.append((x["key"], place, text[begin:place], text[place:stop]))
            if out:
                keys, places, lefts, rights = zip(*out)
                n = len(out)
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array([0] * n, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array(places, pa.int64()), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary()), pa.array([ANCHOR] * n, pa.int8())], names=names)
            if len(strings) > 200_000:
                yield hashed(strings)
                strings = []
        if strings:
            yield hashed(strings)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def intervals(texts: list[bytes]) -> list[tuple[int, int, int]]:
    """(first, end, depth) of each node of the common-prefix interval tree over sorted texts, by a stack scan."""
    found, stack = [], []
    depths = [_common(a, b) for a, b in zip(texts, texts[1:])] + [-1]
    for i, depth in enumerate(depths):
        begin = i
        while stack and stack[-1][1] > depth:
            begin, deep = stack.pop()
            found.append((begin, i + 1, deep))
        if depth >= 0 and (not stack or stack[-1][1] < depth):
            stack.append((begin, depth))
    return found


@dataclass(frozen=True)
class Node:
    """A maximal repeat through one anchor string: the members of ``rights`` in the order of right contexts that are also in ``lefts`` in that of left contexts."""

    left: int
    right: int
    rights: tuple[int, int]
    lefts: tuple[int, int]
    members: list[int]


def maximal_repeats(around: list[tuple[int, int, bytes, bytes]], ranges: bool = True) -> tuple[list[int], list[int], Iterator[Node]]:
    """The orders by right and by left contexts, and the maximal repeats of at least the width through one anchor string.

    ``around`` holds (doc, place, left bytes, right bytes); members are places in it. Left
    contexts are read backwards from the anchor. A node's members are two ranges of ranks (left
    out without ``ranges``), so that nested nodes needn't repeat them.
    """
    order = sorted(range(len(around)), key=lambda i: around[i][3])
    backwards = [x[2][::-1] for x in around]
    by_left = sorted(range(len(around)), key=lambda i: backwards[i])
    lefts, longest = [backwards[i] for i in by_left], max((len(x) for x in backwards), default=0)

    def nodes():
        for begin, stop, right in intervals([around[i][3] for i in order]):
            if right + longest < WIDTH:
                continue
            members = sorted(order[begin:stop], key=lambda i: backwards[i])
            for low, high, left in intervals([backwards[i] for i in members]):
                if left + right < WIDTH:
                    continue
                inner = members[low:high]
                rights = [around[i][3] for i in inner]
                if _common(min(rights), max(rights)) == right:  # else a deeper interval has it
                    cut = lambda x, n=left: x[:n]
                    prefix = backwards[inner[0]][:left]
                    span = (bisect_left(lefts, prefix, key=cut), bisect_right(lefts, prefix, key=cut)) if ranges else (0, 0)
                    yield Node(left, right, (begin, stop), span, inner)

    return order, by_left, nodes()


def widest(around: list[tuple[int, int, bytes, bytes]]) -> dict[int, tuple[int, int]]:
    """For each member that repeats an earlier one: the most bytes left and right of its anchor that lie in such a repeat.

    All these repeats contain the anchor, so together they cover one span.
    """
    out: dict[int, tuple[int, int]] = {}
    for node in maximal_repeats(around, ranges=False)[2]:
        earliest = min(node.members, key=lambda i: around[i][:2])
        for i in node.members:
            if i != earliest:
                left, right = out.get(i, (0, 0))
                if node.left > left or node.right > right:
                    out[i] = (max(left, node.left), max(right, node.right))
    return out


_CUT = "doc long, start long, size int"
_TREE = "group long, repeat long, doc long, start long, size int, leads boolean, place long, rights_from int, rights_to int, lefts_from int, lefts_to int, kind byte"
#: Rows of a group: an occurrence of a repeated string, a maximal repeat with its ranges, a member with its ranks.
OCCURRENCE, NODE, MEMBER = 0, 1, 2


def _cuts_of(group: int, held: list[tuple]) -> list[tuple]:
    return [(held[i][0], held[i][1] - left, left + right) for i, (left, right) in widest(held).items()]


def _tree_of(group: int, held: list[tuple]) -> list[tuple]:
    order, by_left, nodes = maximal_repeats(held)
    out = []
    for node in nodes:
        doc, place, left, right = held[min(node.members, key=lambda i: held[i][:2])]
        name = xxhash.xxh3_64_intdigest(left[len(left) - node.left :] + right[: node.right]) - (1 << 63)
        out.append((group, name, doc, place - node.left, node.left + node.right, True, place, *node.rights, *node.lefts, NODE))
    if out:
        rank = {i: n for n, i in enumerate(by_left)}
        out += [(group, None, held[i][0], None, None, False, held[i][1], n, None, rank[i], None, MEMBER) for n, i in enumerate(order)]
    return out


def _compared(cuts_only: bool):
    """Reads rows sorted by (group, other, doc, place); gives what is to be cut, one span a member at most, or the groups: one row a node and one a member."""
    schema = _CUT if cuts_only else _TREE
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "byte": pa.int8()}[c.split()[1]] for c in schema.split(", ")]

    def string(group, doc, place, leads):
        if cuts_only:
            return None if leads else (doc, place, WIDTH)
        return group, group, doc, place, WIDTH, leads, None, None, None, None, None, OCCURRENCE

    def run(batches):
        out: list[tuple] = []
        held: list[tuple] = []
        last, lead = None, None

        def close():
            if len(held) > 1:
                out.extend((_cuts_of if cuts_only else _tree_of)(last, held))

        def batch_of(rows):
            return pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=names)

        def add(row):
            if row is not None:
                out.append(row)

        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in ("group", "other", "doc", "place", "lefts", "rights", "state"))
            for group, other, doc, place, left, right, state in zip(*columns):
                if state == AGAIN:
                    add(string(other, doc, place, False))
                elif state == STRING:
                    if lead is not None and lead[:2] == (group, other):
                        if lead[2] is not None:
                            add(string(other, *lead[2], True))
                        add(string(other, doc, place, False))
                        lead = (group, other, None)
                    else:
                        lead = (group, other, (doc, place))
                else:
                    if group != last:
                        close()
                        held, last = [], group
                    held.append((doc, place, left, right))
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
        close()
        if out:
            yield batch_of(out)

    return run


def occurrences(tree: DataFrame) -> DataFrame:
    """(repeat, doc, start, size, leads) of every member of every node, written out."""
    nodes = tree.where(F.col("kind") == NODE).select("group", "repeat", "size", (F.col("place") - F.col("start")).alias("left"), F.struct("doc", "place").alias("lead"),
                                                     "rights_from", "rights_to", "lefts_from", "lefts_to")
    members = tree.where(F.col("kind") == MEMBER).select("group", "doc", "place", F.col("rights_from").alias("r"), F.col("lefts_from").alias("l"))
    inside = (F.col("r") >= F.col("rights_from")) & (F.col("r") < F.col("rights_to")) & (F.col("l") >= F.col("lefts_from")) & (F.col("l") < F.col("lefts_to"))
    met = nodes.join(members, "group").where(inside)
    told = met.select("repeat", "doc", (F.col("place") - F.col("left")).alias("start"), "size", (F.struct("doc", "place") == F.col("lead")).alias("leads"))
    return told.unionByName(tree.where(F.col("kind") == OCCURRENCE).select("repeat", "doc", "start", "size", "leads"))


def repeats(docs: DataFrame, hot_rows: int = 5_000, cuts_only: bool = False) -> DataFrame:
    """(repeat, doc, start, size, leads): every occurrence of every repeat found; ``leads`` marks the earliest.

    ``docs`` has unique ids (see ``numbered``). Every 100-byte string that starts earlier
    elsewhere lies in an occurrence that does not lead, and such occurrences hold no others.
    With ``cuts_only`` the result is (doc, start, size): those bytes, one span for each
    anchor at most, so its rows don't grow with how repeats nest in one another.
    """
    texts = docs.select("doc_id", "text").where(F.octet_length("text") >= WIDTH)
    found = texts.mapInArrow(_anchor_rows, _ANCHOR)
    found = found.withColumn("group", F.when(F.col("state") == REPEATS, F.xxhash64("doc", "place")).otherwise(F.col("key")))
    found = found.select("group", "key", "covered", "doc", "place", "first", "last", "state")
    met = materialize(found.repartition("group").sortWithinPartitions("group", "key", "covered", "doc", "place").mapInArrow(_meet(hot_rows), _MET), "met")
    asked = met.where("key is not null").groupBy("doc").agg(F.collect_list(F.struct("key", "place", "first", "last", "hot")).alias("found"))
    beside = texts.join(asked, texts.doc_id == asked.doc).select("doc_id", "text", "found")
    around = beside.mapInArrow(_around, _AROUND)
    around = around.withColumn("deal", F.when(F.col("state") == AGAIN, F.xxhash64("doc", "place")).otherwise(F.col("group")))
    around = around.repartition("deal").sortWithinPartitions("deal", "group", "other", "doc", "place").drop("deal")
    if cuts_only:
        return met.where("size > 0 and not leads").select("doc", "start", "size").unionByName(around.mapInArrow(_compared(True), _CUT))
    tree = materialize(around.mapInArrow(_compared(False), _TREE), "repeat-tree")
    return met.where("size > 0").select("repeat", "doc", "start", "size", "leads").unionByName(occurrences(tree))


def _removed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the list of removed byte spans, overlaps and all, as ``cuts``."""
    cuts = found.groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("cuts"))
    return docs.join(cuts, docs.doc_id == cuts.doc, "left")


def _spans(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's cuts begin among all (one more than rows), their starts and their sizes."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    first = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
    flat = lists.flatten()
    return first, flat.field("start").to_numpy(zero_copy_only=False), flat.field("size").to_numpy(zero_copy_only=False)


def _kept(size: int, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which bytes stay."""
    if not len(start):
        return np.ones(size, bool)
    stop = np.minimum(start + sizes, size)
    cover = np.bincount(start, minlength=size + 1) - np.bincount(stop, minlength=size + 1)
    return np.cumsum(cover[:size]) == 0


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document after its repeats are cut."""
    base = numbered(docs.select("doc_id", "text"))
    kind = base.schema["given"].dataType.simpleString()

    def work(raw, at, rows):
        removed, spans, digests = [], [], []
        first, start, size = _spans(rows.column("cuts"))
        for a, b, i, j in zip(at, at[1:], first, first[1:]):
            kept = _kept(b - a, start[i:j], size[i:j])
            gone = np.append(False, ~kept)
            removed.append(int(gone.sum()))
            spans.append(int((gone[1:] & ~gone[:-1]).sum()))
            digests.append(hashlib.sha256(raw[a:b][kept].tobytes()).hexdigest())
        return {"n_bytes": np.diff(at), "n_removed": removed, "n_spans": spans, "kept_sha256": digests}

    columns = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    cut = _removed(base, repeats(base, cuts_only=True)).select(F.col("given").alias("doc_id"), "text", "cuts")
    return cut.mapInArrow(by_slice(columns, work), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with what is left of each text; a null text stays null. A character stays unless all its bytes are cut."""
    base = numbered(docs)
    columns = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for row, stop, raw, at in slices(table.column("text")):
                rows, out = table.slice(row, stop - row), []
                first, start, size = _spans(rows.column("cuts"))
                for a, b, i, j, missing in zip(at, at[1:], first, first[1:], rows.column("text").is_null().to_pylist()):
                    text, kept = raw[a:b], _kept(b - a, start[i:j], size[i:j])
                    if not kept.all():
                        lead = np.flatnonzero((text & 0xC0) != 0x80)
                        whole = np.maximum.reduceat(kept, lead)
                        text = text[np.repeat(whole, np.diff(np.append(lead, len(text))))]
                    out.append(None if missing else text.tobytes().decode())
                yield from pa.table([pa.array(out, pa.string()), *(rows.column(c) for c in columns)], names=["text", *columns]).to_batches()

    cut = _removed(base.select("doc_id", "text", "given", "row_"), repeats(base, cuts_only=True)).select("text", "cuts", "row_")
    cut = cut.select("text", "cuts", "row_.*").select("text", "cuts", *columns)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ["text", *columns])
    return cut.mapInArrow(run, fields)
