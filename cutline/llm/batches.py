"""Arrow batches as flat byte buffers, so that text work inside a task is vectorised.

Every helper works on slices of bounded size: ``slices`` cuts a batch into runs
of rows of about one megabyte of text (one longer text makes a slice alone). What
a task holds beside its batch is some ten times a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Where distinct units are looked up: a longer slice has fewer of them for its size.
ENCODE_BYTES = 4 << 20

#: The separators of words: blank, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (one more than rows). Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, beginnings) of runs of rows with about ``limit`` bytes."""
    raw, at = flat(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, stop, raw[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def by_slice(columns: dict[str, pa.DataType], work: Callable, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = SLICE_BYTES) -> Callable:
    """A ``mapInArrow`` function: ``work(bytes, beginnings, rows)`` gives the new columns of each slice.

    ``rows`` holds the other columns of the slice. The columns in ``keep`` come first in the result.
    """

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for row, stop, raw, at in slices(table.column(text), limit):
                rows = table.slice(row, stop - row)
                made = work(raw, at, rows)
                if made is None:
                    continue
                yield from pa.table(
                    [rows.column(k) for k in keep] + [pa.array(made[k], kind) for k, kind in columns.items()], names=[*keep, *columns]
                ).to_batches()

    return run


def words(raw: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beginning and end of each word, and the first word of each text (one more than texts)."""
    solid = ~space[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0], edge[-1] = (len(raw) > 0 and solid[0]), False
    edge[1:-1] = solid[1:] & ~solid[:-1]
    inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
    edge[inner] = solid[inner]  # a text that begins with a word right after another text
    start = np.flatnonzero(edge)
    last = np.zeros(len(raw) + 1, bool)
    if len(raw):
        last[1:-1] = solid[:-1] & ~solid[1:]
        last[-1] = solid[-1]
        last[inner] |= solid[inner - 1]
    return start, np.flatnonzero(last), np.searchsorted(start, at)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions of all ranges, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


def pieces(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The byte strings raw[start:stop] as one Arrow array."""
    length = stop - start
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(length, out=offsets[1:])
    together = len(start) and np.array_equal(stop[:-1], start[1:])
    data = raw[start[0] : stop[-1]] if together else raw[ranges(start, length)]
    return pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def coded(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each string among the distinct ones, and those."""
    held = strings.dictionary_encode()
    return held.indices.to_numpy(zero_copy_only=False), held.dictionary


def number(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal keys get equal numbers from 0; how many there are."""
    codes, distinct = pd.factorize(keys)
    return codes.astype(np.int64), len(distinct)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` from first[i] to first[i + 1]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


#: Bytes that may follow the blank before which a text is cut: no white space begins with them.
_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = _GRAPHIC[0xC3:0xE1] = _GRAPHIC[0xE4:0xF5] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True


def units(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut where every tokenizer pattern used here cuts them as well.

    That is before a single blank with a graphic character behind it, and between
    an ASCII letter and a comma or full stop. A tokenizer gives a unit the same
    ids alone as inside its text. Returns beginnings, ends, first unit of each text.
    """
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw):
        cut[1:-1] = (_LETTER[raw[:-1]] & _STOP[raw[1:]])
        cut[:-2] |= (raw[:-1] == 0x20) & _GRAPHIC[raw[1:]]
        cut[at[:-1]] = True
        cut[-1] = False
    start = np.flatnonzero(cut)
    stop = np.append(start[1:], len(raw)) if len(start) else start
    return start, stop, np.searchsorted(start, at)


class Spans:
    """Id sequences kept end to end; grows by appending, gathered by number."""

    def __init__(self, dtype=np.uint32):
        self.ids, self.first, self.used, self.count = np.zeros(1 << 16, dtype), np.zeros(1 << 12, np.int64), 0, 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(lengths) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[self.count + 1 : self.count + len(lengths) + 1] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.count += len(lengths)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered sequences in a row, and their lengths."""
        begin = self.first[numbers]
        length = self.first[numbers + 1] - begin
        return self.ids[ranges(begin, length)], length


_UNIT_BASE = 0x9E3779B97F4A7C15


def _unit_keys(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text, the same wherever its bytes lie."""
    n = len(raw)
    with np.errstate(over="ignore"):
        steps, back = np.full(n + 1, _UNIT_BASE, np.uint64), np.full(n + 1, pow(_UNIT_BASE, -1, 1 << 64), np.uint64)
        steps[0] = back[0] = 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(steps)[:-1], out=total[1:])
        keys = (total[at[1:]] - total[at[:-1]]) * np.multiply.accumulate(back)[at[:-1]]
        return (keys ^ (keys >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


class _Generation:
    """Units by hash, with their bytes and ids in flat arrays: some fifty bytes each."""

    def __init__(self, dtype):
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.texts, self.ids = Spans(np.uint8), Spans(dtype)

    def find(self, keys: np.ndarray, raw: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The number of each unit in ``rows``, or -1; units of equal hash are told apart by their bytes."""
        out = np.full(len(rows), -1, np.int64)
        if not len(self.keys) or not len(rows):
            return out
        k = np.minimum(np.searchsorted(self.keys, keys[rows]), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[k] == keys[rows])
        number, begin = self.place[k[hit]], at[rows[hit]]
        own = at[rows[hit] + 1] - begin
        length = self.texts.first[number + 1] - self.texts.first[number]
        fit = own == length
        hit, number, begin, own = hit[fit], number[fit], begin[fit], own[fit]
        off = raw[ranges(begin, own)] != self.texts.gather(number)[0]
        same = per_text(off, np.append(0, np.cumsum(own))) == 0
        out[hit[same]] = number[same]
        return out

    def add(self, keys: np.ndarray, raw: np.ndarray, at: np.ndarray, rows: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of new units. One whose hash is taken gets a number as well, but isn't found by it again."""
        numbers = np.arange(self.ids.count, self.ids.count + len(rows))
        own = at[rows + 1] - at[rows]
        self.texts.add(raw[ranges(at[rows], own)], own)
        self.ids.add(ids, lengths)
        new, first = np.unique(keys[rows], return_index=True)
        k = np.searchsorted(self.keys, new)
        free = np.append(self.keys, np.uint64(0))[k] != new if len(self.keys) else np.ones(len(new), bool)
        free |= k == len(self.keys)
        self.keys = np.insert(self.keys, k[free], new[free])
        self.place = np.insert(self.place, k[free], numbers[first[free]])
        return numbers


class UnitCache:
    """Ids by unit for one Python worker, in two generations of up to ``most`` units each.

    A unit that is met moves to the young one. When that is full it becomes the old one, and
    the units that were not met since the last change are dropped; no result depends on it.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 400_000, dtype=np.uint32):
        self.encode, self.most, self.dtype = encode, most, dtype
        self.young, self.old = _Generation(dtype), _Generation(dtype)

    def ids(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin."""
        start, stop, first = units(raw, at)
        if not len(start):
            return np.zeros(0, self.dtype), np.zeros(len(at), np.int64)
        codes, distinct = coded(pieces(raw, start, stop))
        if self.young.ids.count + len(distinct) > self.most:
            self.young, self.old = _Generation(self.dtype), self.young
        text, begin = flat(distinct)
        keys = _unit_keys(text, begin)
        number = self.young.find(keys, text, begin, np.arange(len(keys)))
        rows = np.flatnonzero(number < 0)
        again = self.old.find(keys, text, begin, rows)
        met, fresh = rows[again >= 0], rows[again < 0]
        if len(met):
            number[met] = self.young.add(keys, text, begin, met, *self.old.ids.gather(again[again >= 0]))
        if len(fresh):
            number[fresh] = self.young.add(keys, text, begin, fresh, *self.encode(distinct.take(pa.array(fresh)).to_pylist()))
        ids, length = self.young.ids.gather(number[codes])
        ends = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=ends[1:])
        return ids, ends[first]
