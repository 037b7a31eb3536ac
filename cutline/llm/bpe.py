"""Byte-level BPE over padded numpy matrices.

Distinct pieces are put in buckets of like length, one row each. Every round
looks up all new neighbour pairs in a hash table, merges each row's leftmost
pair of least rank, closes the gap and drops the rows that are done. A piece of
over ``LONG`` bytes would make rounds of its own; it is merged through a heap
instead, with the same result.

Edge cases: a null or empty text has no ids (and decodes to nothing); repeated
rows give repeated results; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cutline.llm.batches import ENCODE_BYTES, UnitCache, by_slice, ranges

LONG = 256
CELLS = 1 << 20
NONE = np.int64(1) << 40
EDGES = np.array([2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 192, LONG])
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressed hash table from a pair of ids to the id (and rank) of its merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(len(left) * 4 - 1).bit_length()) if len(left) else 4
        size = 1 << self.bits
        self.keys, self.values = np.full(size, np.uint64(2**64 - 1)), np.full(size, NONE)
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot, self.probes = self._slot(keys), 1
        left_over = np.arange(len(keys))
        while len(left_over):
            free = self.values[slot[left_over]] == NONE
            tried = left_over[free]
            _, first = np.unique(slot[tried], return_index=True)
            won = tried[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], value[won]
            left_over = np.setdiff1d(left_over, won, assume_unique=True)
            slot[left_over] = (slot[left_over] + 1) & (size - 1)
            self.probes += bool(len(left_over))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge of each pair, NONE where there is none or a side is padding (-1)."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot, out = self._slot(keys), np.full(keys.shape, NONE)
        open_ = (left >= 0) & (right >= 0)
        for _ in range(self.probes):
            hit = open_ & (self.keys[slot] == keys)
            out[hit] = self.values[slot[hit]]
            open_ = open_ & ~hit & (self.values[slot] != NONE)
            if not open_.any():
                break
            slot = (slot + 1) & (len(self.keys) - 1)
        return out


class Ranks:
    """A vocabulary of ranked byte strings: the lower rank merges first."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.tokens[bytes([i])] for i in range(256)], np.int64)
        most = max(self.tokens.values()) + 1
        by_id = [b""] * most
        for token, rank in self.tokens.items():
            by_id[rank] = token
        self.table = np.frombuffer(b"".join(by_id), np.uint8)
        self.first = np.zeros(most + 1, np.int64)
        np.cumsum([len(x) for x in by_id], out=self.first[1:])
        splits = [(a, b, rank) for token, rank in self.tokens.items() for i in range(1, len(token))
                  if (a := self.tokens.get(token[:i])) is not None and (b := self.tokens.get(token[i:])) is not None]
        self.pairs = PairTable(*(np.array(x, np.int64) for x in zip(*splits))) if splits else PairTable(*[np.zeros(0, np.int64)] * 3)
        self.cache = UnitCache(self.encode_units)

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each unit: cut by the pattern, distinct pieces merged together."""
        known: dict[str, int] = {}
        flat, counts = [], np.zeros(len(units), np.int64)
        for k, unit in enumerate(units):
            text = unit.decode()
            plain = text[1:] if text[0] == " " else text
            if plain.isalpha() and plain.isascii():
                flat.append(known.setdefault(text, len(known)))
                counts[k] = 1
            else:
                found = self.pattern.findall(text)
                flat += [known.setdefault(x, len(known)) for x in found]
                counts[k] = len(found)
        ids, length = self.merge([x.encode() for x in known])
        begin = np.cumsum(length) - length
        each = np.array(flat, np.int64)
        ends = np.zeros(len(units) + 1, np.int64)
        np.cumsum(counts, out=ends[1:])
        total = np.zeros(len(each) + 1, np.int64)
        np.cumsum(length[each], out=total[1:])
        return ids[ranges(begin[each], length[each])].astype(np.uint32), total[ends[1:]] - total[ends[:-1]]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and their number for each piece."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        begin = np.cumsum(size) - size
        out, length = symbols.copy(), size.copy()
        for low, high in zip(np.append(1, EDGES[:-1]), EDGES):
            rows = np.flatnonzero((size > low) & (size <= high))
            for at in range(0, len(rows), max(1, CELLS // int(high))):
                part = rows[at : at + max(1, CELLS // int(high))]
                matrix = np.full((len(part), int(high)), -1, np.int64)
                inside = np.arange(high)[None, :] < size[part][:, None]
                matrix[inside] = symbols[ranges(begin[part], size[part])]
                for rows_done, ids in self._rounds(matrix):
                    n = (ids >= 0).sum(1)
                    length[part[rows_done]] = n
                    out[ranges(begin[part[rows_done]], n)] = ids[ids >= 0]
        for k in np.flatnonzero(size > LONG):
            ids = self._heap(symbols[begin[k] : begin[k] + size[k]].tolist())
            length[k] = len(ids)
            out[begin[k] : begin[k] + len(ids)] = ids
        return out[ranges(begin, length)], length

    def _rounds(self, ids: np.ndarray):
        """Merges row by row until nothing merges; yields (rows, their ids) as they end."""
        rows = np.arange(len(ids))
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:])
        while len(ids):
            at = rank.argmin(1)
            least = rank[np.arange(len(ids)), at]
            done = least == NONE
            if done.any():
                yield rows[done], ids[done]
                ids, rank, rows, at, least = ids[~done], rank[~done], rows[~done], at[~done], least[~done]
                if not len(ids):
                    return
            each, width = np.arange(len(ids)), ids.shape[1]
            ids[each, at] = least
            ids = np.take_along_axis(ids, np.arange(width - 1)[None, :] + (np.arange(width - 1)[None, :] > at[:, None]), 1)
            if width == 2:
                yield rows, ids
                return
            rank = np.take_along_axis(rank, np.arange(width - 2)[None, :] + (np.arange(width - 2)[None, :] >= at[:, None]), 1)
            for side in (at - 1, at):
                ok = (side >= 0) & (side < width - 2)
                r, c = each[ok], side[ok]
                rank[r, c] = self.pairs.get(ids[r, c], ids[r, c + 1])

    def _heap(self, ids: list[int]) -> list[int]:
        """The same merges of one long piece: pairs wait in a heap by (rank, place)."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        ranks = self.pairs.get(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else len(ids)
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for p in (before[i], i):
                q = after[p] if p >= 0 else len(ids)
                if p >= 0 and q < len(ids) and (r := int(self.pairs.get(np.array([ids[p]]), np.array([ids[q]]))[0])) != NONE:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.cache.ids(raw, at)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all sequences in a row, and where each begins."""
        begin, size = self.first[ids], self.first[ids.astype(np.int64) + 1] - self.first[ids]
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        return self.table[ranges(begin, size)], total[at]


_LOADED: dict[tuple[str, str], Ranks] = {}


def ranks(path: str, pattern: str) -> Ranks:
    """One vocabulary for each Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Ranks(path, pattern)
    return _LOADED[path, pattern]


def _lists(flat: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, kind))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc id, ids): the whole text of each row as token ids."""

    def work(raw, at, rows):
        ids, ends = ranks(path, pattern).encode(raw, at)
        return {"ids": _lists(ids.astype(np.int32), ends, pa.int32())}

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(by_slice({"ids": pa.list_(pa.int32())}, work, text_col, (id_col,), ENCODE_BYTES), f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(doc id, bytes): the inverse of ``encode``. Null ids give empty bytes."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
            at = np.zeros(len(lists) + 1, np.int64)
            np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), out=at[1:])
            raw, ends = ranks(path, pattern).decode(lists.flatten().to_numpy(zero_copy_only=False), at)
            data = raw.tobytes()
            yield pa.record_batch([batch.column(id_col), pa.array([data[a:b] for a, b in zip(ends, ends[1:])], pa.binary())], names=[id_col, "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes each text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def work(raw, at, rows):
        held = ranks(path, pattern)
        ids, ends = held.encode(raw, at)
        back, begins = held.decode(ids, ends)
        words, back = ids.astype("<u4"), np.ascontiguousarray(back)
        return {
            "n_tokens": np.diff(ends),
            "ids_sha256": [hashlib.sha256(words[a:b]).hexdigest() for a, b in zip(ends, ends[1:])],
            "decoded_sha256": [hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(begins, begins[1:])],
        }

    columns = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(by_slice(columns, work, limit=ENCODE_BYTES), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
