"""Token ids as raw binary shards with a minimal perfect hash index.

A shard is two files in a shared folder. ``<name>.ids`` holds the ids of its
documents end to end, little-endian, two bytes each if the vocabulary allows and
four otherwise. ``<name>.idx`` holds the index: a header, the bit levels of the
hash, and for each slot the document's place in the shard and a 32-bit
fingerprint of its key, by which a foreign key is refused. Looking a key up takes a
few bit tests and one read, whatever the size.

Shards are ranges of ascending ids, written by the tasks themselves. A task names
its files anew on every attempt and the manifest lists those of the attempts that
counted, so a lost executor leaves at most orphans.

Edge cases: a null or empty text is stored as its end id alone; rows that share an
id stay together in the order of their texts and the key leads to all of them; rows
with a null id are stored last, reached by place only; an empty table makes an
empty manifest; ids must be integral; other columns are not read. With ``added`` the
strings of added tokens in a text become those tokens, as in a plain library call.
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutline.llm.batches import ENCODE_BYTES, slices
from cutline.llm.vocab import library
from cutline.session import checkpoint_dir, materialize

MAGIC = b"idshard1"
GAMMA, LEVELS = 2.0, 48
_U = np.uint64


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit keys for each seed, so that no two keys always meet."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + _U((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _print(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1_000) >> _U(32)).astype(np.uint32)


@dataclass
class PerfectHash:
    """Distinct keys to 0 .. n - 1. Each level has a bit for every key that is alone at its place there."""

    sizes: np.ndarray  # bits of each level, a multiple of 64
    words: np.ndarray  # all levels end to end
    left: np.ndarray  # keys that no level could place, in ascending order

    def __post_init__(self):
        self.first = np.append(0, np.cumsum(self.sizes))
        self.ranks = np.append(0, np.cumsum(np.bitwise_count(self.words).astype(np.int64)))

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = max(64, -(-int(len(keys) * GAMMA) // 64) * 64)
            place = (_hash(keys, level) % _U(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[place]]
        return PerfectHash(np.array(sizes, np.int64), np.concatenate(words).astype(np.uint64) if words else np.zeros(0, np.uint64), np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for a key that no level knows. A foreign key may get a slot."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            bit = (_hash(keys[open_], level) % _U(size)).astype(np.int64) + self.first[level]
            word, within = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> within) & _U(1) == 1
            below = np.bitwise_count(word & ((_U(1) << within) - _U(1))).astype(np.int64)
            out[open_[hit]] = self.ranks[(bit >> 6)[hit]] + below[hit]
            open_ = open_[~hit]
        if len(open_) and len(self.left):
            at = np.minimum(np.searchsorted(self.left, keys[open_]), len(self.left) - 1)
            hit = self.left[at] == keys[open_]
            out[open_[hit]] = self.ranks[-1] + at[hit]
        return out


def _folder(folder: str):
    return pyarrow.fs.FileSystem.from_uri(folder)


def _write_index(out, docs: np.ndarray, nulls: int, starts: np.ndarray, item: int) -> None:
    keys, place, count = np.unique(docs, return_index=True, return_counts=True)
    held = PerfectHash.build(keys)
    slot = held.slots(keys)
    first, many, prints = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32)
    first[slot], many[slot], prints[slot] = place, count, _print(keys)
    arrays = {"sizes": held.sizes.astype("<i8"), "words": held.words.astype("<u8"), "left": held.left.astype("<i8"), "first": first.astype("<u4"), "many": many.astype("<u4"), "prints": prints.astype("<u4"), "docs": docs.astype("<i8"), "starts": starts.astype("<i8")}
    header = json.dumps({"item": item, "nulls": nulls, "arrays": {k: [v.dtype.str, len(v)] for k, v in arrays.items()}}).encode()
    out.write(MAGIC + len(header).to_bytes(8, "little") + header)
    for x in arrays.values():
        out.write(x.tobytes())


class Shard:
    """A shard opened for reading."""

    def __init__(self, folder: str, name: str):
        fs, path = _folder(folder)
        with fs.open_input_file(f"{path}/{name}.idx") as file:
            data = file.read()
        if data[:8] != MAGIC:
            raise ValueError(f"{name}.idx is no index of this format")
        at = 16 + int.from_bytes(data[8:16], "little")
        header = json.loads(data[16:at])
        self.item, self.nulls = header["item"], header["nulls"]
        for key, (kind, n) in header["arrays"].items():
            setattr(self, key, np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.index = PerfectHash(self.sizes.astype(np.int64), self.words.astype(np.uint64), self.left.astype(np.int64))
        self.payload = fs.open_input_file(f"{path}/{name}.ids")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the documents under each key; number 0 for a key that isn't here."""
        slot = self.index.slots(keys)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == _print(keys[known])
        place, many = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        place[known], many[known] = self.first[slot[known]], self.many[slot[known]]
        return place, many

    def ids(self, place: int, many: int = 1) -> np.ndarray:
        """The ids of ``many`` documents from ``place`` on, by one read."""
        begin, stop = int(self.starts[place]), int(self.starts[place + many])
        self.payload.seek(begin * self.item)
        return np.frombuffer(self.payload.read((stop - begin) * self.item), f"<u{self.item}")


_MANIFEST = "shard int, name string, docs long, ids long, first_doc long, last_doc long"


def write(docs: DataFrame, path: str, kind: str, end: int, folder: str, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """Encodes all texts and writes the shards to ``folder``; returns the manifest, stored there as well."""
    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{id_col} must be integral")
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held = library(path, kind, added)
        item = 2 if max(held.size, end + 1) <= 1 << 16 else 4
        fs, root = _folder(folder)
        fs.create_dir(root, recursive=True)
        shard, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        docs_, sizes, nulls = [], [], 0
        with fs.open_output_stream(f"{root}/{name}.ids") as out:
            for batch in batches:
                keys = batch.column("doc_id")
                nulls += keys.null_count
                docs_.append(keys.drop_null().to_numpy(zero_copy_only=False))
                for _, _, raw, at in slices(batch.column("text"), ENCODE_BYTES):
                    ids, first = held.with_end(raw, at, end)
                    out.write(ids.astype(f"<u{item}").tobytes())
                    sizes.append(np.diff(first))
        keys = np.concatenate(docs_) if docs_ else np.zeros(0, np.int64)
        starts = np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1, np.int64)
        with fs.open_output_stream(f"{root}/{name}.idx") as out:
            _write_index(out, keys, nulls, starts, item)
        if len(starts) > 1:
            yield pa.record_batch([pa.array([x], t) for x, t in ((shard, pa.int32()), (name, pa.string()), (len(starts) - 1, pa.int64()), (int(starts[-1]), pa.int64()), (int(keys[0]) if len(keys) else None, pa.int64()), (int(keys[-1]) if len(keys) else None, pa.int64()))], names=["shard", "name", "docs", "ids", "first_doc", "last_doc"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_last()]
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    return materialize(ranged.mapInArrow(run, _MANIFEST), "manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every stored document, found by its key."""
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("ids")
    based = manifest.select("shard", "name", before.alias("base"))  # a row for each shard

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                shard = Shard(folder, name)
                keys = np.unique(shard.docs)
                place, many = shard.find(keys)
                order = np.argsort(place, kind="stable")
                keys, place, many = keys[order], place[order], many[order]
                loose = np.arange(len(shard.docs), len(shard.starts) - 1)  # null ids
                known = np.concatenate([np.ones(len(keys), bool), np.zeros(len(loose), bool)])
                keys, place, many = np.append(keys, np.zeros(len(loose), np.int64)), np.append(place, loose), np.append(many, np.ones(len(loose), np.int64))
                for a in range(0, len(keys), 1024):
                    ids_of, out = [], {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                    for k in range(a, min(a + 1024, len(keys))):
                        p, n = int(place[k]), int(many[k])
                        ids_of = shard.ids(p, n).astype("<u4")
                        for i in range(p, p + n):
                            x, y = int(shard.starts[i] - shard.starts[p]), int(shard.starts[i + 1] - shard.starts[p])
                            out["doc_id"].append(int(keys[k]) if known[k] else None)
                            out["start"].append(base + int(shard.starts[i]))
                            out["n_tokens"].append(y - x)
                            out["ids_crc32"].append(zlib.crc32(ids_of[x:y]))
                    yield pa.record_batch([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    shards = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(shards, "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored(docs: DataFrame, path: str, kind: str, end: int, added: bool = False) -> DataFrame:
    """Writes the shards to a new folder in the shared one and reads them back."""
    folder = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/ids-{uuid.uuid4().hex}"
    return read(write(docs, path, kind, end, folder, added=added), folder)
