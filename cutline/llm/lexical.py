"""Ranked lexical search by sequential reads of impact-sorted lists (no random access).

A task turns each run of documents into a shard: which documents hold which term how
often. Only the terms that a bitmap of the queries' terms lets through are kept (a fixed
number of bits, so a false hit costs space and nothing else). Shards stay where they are
made; no posting is shuffled, and a term that stands in every document is split over
all shards. Counts of documents per term are summed per shard before they are shuffled.

In a shard each of a query's lists is sorted by impact. Reading them side by side, a
document's score lies between the sum of what was read of it and that sum plus the last
impact read of every list in which it was not met yet. Documents whose upper end is below
the k-th lower end are out. Reading goes on until each document left has one value as both
ends and unread documents can't come up to the k-th, so membership, ties and scores
are exact. The k-th score that a task has found bounds its later shards.

Scores are whole numbers; see :func:`search`. Queries come in bounded blocks.

Edge cases: a null or empty text has no terms and isn't counted as a document; very long
texts make a shard of their own; rows with a repeated id are documents of their own; rows
without an id are ranked with a null id, after others of equal score; items that share an
id are one item with the terms of both; an item without known terms has no result; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutline.llm import batches as B
from cutline.session import materialize

#: Bytes outside terms: all of ASCII but digits and letters.
GAP = np.zeros(256, bool)
GAP[:128] = True
GAP[48:58] = GAP[65:91] = GAP[97:123] = False


@dataclass(frozen=True)
class Settings:
    #: A shard is closed once it has so many documents or postings (one slice more at most).
    shard_docs: int = 8_192
    shard_postings: int = 1 << 19
    #: Bits of the bitmap of query terms.
    bits: int = 1 << 22
    #: Terms of the queries of one block (one item more at most).
    block_terms: int = 1 << 18
    #: Impacts read of each list at a time, doubled from step to step.
    first_read: int = 256


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def word_bits(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, bits: int) -> np.ndarray:
    """A bit number for each byte string raw[start:stop], equal for equal strings."""
    inverse = pow(int(_BASE), -1, 1 << 64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(len(raw), int(_BASE))[:-1], out=total[1:])
        mixed = (total[stop] - total[start]) * _powers(len(raw), inverse)[start]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(20)).astype(np.int64) % bits


def _terms(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = B.ASCII_LOWER[raw]
    return raw, *B.words(raw, at, GAP)


def _item_terms():
    """(item_id, term) of each text, repeats included."""

    def run(batches):
        for batch in batches:
            for row, stop, raw, at in B.slices(batch.column("text")):
                raw, begin, end, first = _terms(raw, at)
                owner = np.repeat(np.arange(row, stop), np.diff(first))
                yield pa.record_batch([batch.column("item_id").take(pa.array(owner)), B.pieces(raw, begin, end).cast(pa.string())], names=["item_id", "term"])

    return run


def _bitmap(terms: DataFrame, bits: int) -> np.ndarray:
    """Which bits the terms have: ``bits`` / 64 longs at most, summed up by Spark."""

    def run(batches):
        for batch in batches:
            raw, at = B.flat(batch.column("term"))
            bit = word_bits(raw, at[:-1], at[1:], bits)
            word, place = np.unique(bit >> 6, return_inverse=True)
            held = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(held, place, np.uint64(1) << (bit & 63).astype(np.uint64))
            yield pa.record_batch([pa.array(word), pa.array(held.view(np.int64))], names=["word", "held"])

    words = terms.mapInArrow(run, "word long, held long").groupBy("word").agg(F.bit_or("held").alias("held")).toArrow()
    out = np.zeros(-(-bits // 64), np.uint64)
    out[words.column("word").to_numpy()] = words.column("held").to_numpy().astype(np.int64).view(np.uint64)
    return out


_SHARD = "docs long, terms_total long, ids binary, lengths binary, terms array<string>, first binary, doc binary, tf binary"


class _Shard:
    """Postings gathered until they are many enough."""

    def __init__(self):
        self.ids, self.lengths, self.words, self.doc, self.tf, self.n, self.postings = [], [], [], [], [], 0, 0

    def add(self, ids: np.ndarray, lengths: np.ndarray, words: pa.Array, doc: np.ndarray, tf: np.ndarray) -> None:
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.words.append(words)
        self.doc.append(doc + self.n)
        self.tf.append(tf)
        self.n += len(ids)
        self.postings += len(doc)

    def row(self) -> pa.RecordBatch:
        """Postings by term, in the order of documents."""
        words = pa.chunked_array(self.words, pa.binary()).combine_chunks()
        code, names = B.coded(words) if len(words) else (np.zeros(0, np.int64), pa.array([], pa.binary()))
        doc, tf = np.concatenate(self.doc), np.concatenate(self.tf)
        order = np.argsort(code, kind="stable")
        first = np.searchsorted(code[order], np.arange(len(names) + 1))
        lengths = np.concatenate(self.lengths)
        blob = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
        return pa.record_batch(
            [pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]), blob(np.concatenate(self.ids), "<i8"), blob(lengths, "<i8"),
             pa.array([names.cast(pa.string()).to_pylist()], pa.list_(pa.string())), blob(first, "<i8"), blob(doc[order], "<i4"), blob(tf[order], "<i4")],
            names=[c.split()[0] for c in _SHARD.split(", ")],
        )


#: The id that stands for null inside a shard.
_NONE = (1 << 63) - 1


def _shards(bitmap: np.ndarray, settings: Settings):
    def run(batches):
        shard = _Shard()
        for batch in batches:
            ids = batch.column("doc_id").fill_null(_NONE).to_numpy()
            for row, stop, raw, at in B.slices(batch.column("text")):
                raw, begin, end, first = _terms(raw, at)
                lengths = np.diff(first)
                bit = word_bits(raw, begin, end, settings.bits)
                known = np.flatnonzero((bitmap[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1))
                code, names = B.coded(B.pieces(raw, begin[known], end[known]))
                owner = np.repeat(np.arange(stop - row), lengths)[known]
                pair, tf = np.unique(owner * max(len(names), 1) + code, return_counts=True)
                doc, code = np.divmod(pair, max(len(names), 1))
                shard.add(ids[row:stop], lengths, names.take(pa.array(code)), doc, tf)
                if shard.n >= settings.shard_docs or shard.postings >= settings.shard_postings:
                    yield shard.row()
                    shard = _Shard()
        if shard.n:
            yield shard.row()

    return run


def index(docs: DataFrame, terms: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Stored shards of ``docs`` (doc_id, text) with the postings of ``terms`` (term) and of what shares a bit with one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(_shards(_bitmap(terms, settings.bits), settings), _SHARD), "shards")


def weights(shards: DataFrame, terms: DataFrame) -> tuple[DataFrame, int, int]:
    """(item_id, term, w) of the terms that documents hold, the number of documents with terms, and that of all their terms."""
    n, total = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms_total"), F.lit(0))).first()

    def counts(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                first = np.frombuffer(batch.column("first")[i].as_py(), "<i8")
                yield pa.record_batch([pa.array(batch.column("terms")[i].as_py(), pa.string()), pa.array(np.diff(first))], names=["term", "df"])

    df = shards.select("terms", "first").mapInArrow(counts, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    odds = F.lit(2.0 * n + 2.0) / (2.0 * F.col("df").cast("double") + 1.0)
    return terms.join(df, "term").select("item_id", "term", F.floor(1000 * F.log(odds)).cast("long").alias("w")), n, total


class _Queries:
    """A block of items: their ids, and their terms with weights end to end."""

    def __init__(self, rows: list):
        self.ids = [r.item_id for r in rows]
        self.first = np.concatenate([[0], np.cumsum([len(r.terms) for r in rows])]).astype(np.int64)
        code, self.names = B.coded(pa.array([t.term for r in rows for t in r.terms], pa.string()))
        self.term = code.astype(np.int64)
        self.w = np.array([t.w for r in rows for t in r.terms], np.int64)


def _query_blocks(weighted: DataFrame, most: int) -> Iterator[_Queries]:
    held, size = [], 0
    for row in weighted.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("terms")).toLocalIterator():
        held.append(row)
        size += len(row.terms)
        if size >= most:
            yield _Queries(held)
            held, size = [], 0
    if held:
        yield _Queries(held)


class Lists:
    """A shard's postings, each list in descending order of impact."""

    def __init__(self, row: dict, n: int, total: int):
        self.ids = np.frombuffer(row["ids"], "<i8")
        lengths = np.frombuffer(row["lengths"], "<i8")
        self.terms, self.first = pa.array(row["terms"], pa.string()), np.frombuffer(row["first"], "<i8")
        doc, tf = np.frombuffer(row["doc"], "<i4"), np.frombuffer(row["tf"], "<i4").astype(np.int64)
        m = 10 + _share(lengths, n, total)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        order = np.lexsort((-impact, np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))))
        self.doc, self.impact = doc[order], impact[order]

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.first[term], self.first[term + 1])
        return self.doc[span], self.impact[span]


def _share(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """(90 * lengths * n) div total, exact beyond 64 bits too."""
    if int(lengths.max(initial=0)) * 90 * max(n, 1) < 1 << 63:
        return 90 * lengths * n // max(total, 1)
    return np.array([90 * int(x) * n // total for x in lengths], np.int64)


def resolve(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, k: int, bound: int, first_read: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the ``k`` best of a shard whose score may reach ``bound``, by interval (ties to smaller ids).

    ``lists`` hold documents and whole impacts, highest first. They are read side by side and only forwards.
    """
    lower, met = np.zeros(len(ids), np.int64), np.zeros((len(lists), len(ids)), bool)
    frontier = np.array([impact[0] for _, impact in lists], np.int64)
    read, step = 0, first_read
    touched = np.zeros(len(ids), bool)
    alive: np.ndarray | None = None  # None: documents not met yet may still come up
    while True:
        for i, (doc, impact) in enumerate(lists):
            if frontier[i] == 0:
                continue
            part, value = doc[read : read + step], impact[read : read + step]
            lower[part] += value
            met[i, part] = touched[part] = True
            frontier[i] = 0 if read + step >= len(doc) else value[-1]
        read, step = read + step, step * 2
        open_ = int(frontier.sum())
        held = np.flatnonzero(touched) if alive is None else alive
        low = lower[held]
        least = max(bound, 1, int(np.partition(low, len(low) - k)[len(low) - k]) if len(low) >= k else 1)
        if open_:
            missing = np.full(len(held), open_, np.int64)
            for i in np.flatnonzero(frontier):
                missing -= frontier[i] * met[i, held]
        else:
            missing = np.zeros(len(held), np.int64)
        keep = low + missing >= least
        held, low, missing = held[keep], low[keep], missing[keep]
        if alive is not None or open_ < least:
            alive = held
        if alive is not None and not missing.any() or not open_:
            break
    order = np.lexsort((ids[held], -low))[:k]
    return held[order], low[order]


def _search(queries: _Queries, n: int, total: int, k: int, settings: Settings):
    """The best ``k`` of each item among a task's shards."""

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for s in range(batch.num_rows):
                shard = Lists({c: batch.column(c)[s].as_py() for c in ("ids", "lengths", "terms", "first", "doc", "tf")}, n, total)
                place = pc.index_in(queries.names, value_set=shard.terms).fill_null(-1).to_numpy() if len(shard.terms) else np.full(len(queries.names), -1)
                for q in range(len(queries.ids)):
                    span = slice(queries.first[q], queries.first[q + 1])
                    lists = []
                    for t, w in zip(place[queries.term[span]], queries.w[span]):
                        if t >= 0 and w > 0:
                            doc, impact = shard.of(t)
                            if impact[0] > 0:
                                lists.append((doc, w * impact))
                    if not lists:
                        continue
                    ids, scores = best.get(q, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    doc, found = resolve(lists, shard.ids, k, int(scores[-1]) if len(scores) == k else 1, settings.first_read)
                    ids, scores = np.concatenate([ids, shard.ids[doc]]), np.concatenate([scores, found])
                    order = np.lexsort((ids, -scores))[:k]
                    best[q] = (ids[order], scores[order])
        for q, (ids, scores) in best.items():
            yield pa.record_batch([pa.array(np.full(len(ids), q, np.int32)), pa.array(ids, mask=ids == _NONE), pa.array(scores)], names=["q", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, settings: Settings = Settings()) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents (doc_id, text) with the highest scores above 0 for each item (item_id, text).

    A score sums over the item's terms, once each, w * ((10**9 * tf) div (1000 * tf + 8 * m)) with
    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m = 10 + (90 * n * N) div L.
    """
    spark = docs.sparkSession
    terms = materialize(items.select("item_id", "text").mapInArrow(_item_terms(), f"item_id {items.schema['item_id'].dataType.simpleString()}, term string").distinct(), "terms")
    shards = index(docs, terms, settings)
    weighted, n, total = weights(shards, terms)
    parts = []
    for block in _query_blocks(weighted, settings.block_terms):
        found = shards.mapInArrow(_search(block, n, total, k, settings), "q int, doc_id long, score long")
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        top = found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"q int, item_id {items.schema['item_id'].dataType.simpleString()}")
        parts.append(materialize(top.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"), "ranked"))  # names are bounded like the block
    if not parts:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
