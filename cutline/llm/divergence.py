"""Quality by distribution: a document's histograms against those of its language.

Two histograms are compared by Jensen-Shannon distance (the root of the
divergence in bits, 0 to 1): code points by character class, and words by the
language's common words, all other words being one bin. The references are
counts over all documents of a language.

Guards: a document shorter than ``min_chars`` code points or ``min_words`` words
gets no verdict from that histogram and passes it. Languages that hold under
``min_share`` of all words or under ``min_reference`` words are judged by one pooled
reference, counted over all their documents. So at most 1 / min_share languages have
a reference of their own, which bounds what each task is given.

Edge cases: a null text has no words, fails the base rules and is not kept; a
null language is a language of its own; repeated rows count as often as they
occur; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutline.llm.batches import SPACE, by_slice, coded, number, per_text, pieces, slices, words
from cutline.session import materialize

CLASSES = ("lower", "upper", "digit", "blank", "break", "stop", "symbol", "control", "latin", "two bytes", "three bytes", "four bytes")
_CLASS = np.full(256, 255, np.uint8)
for _first, _last, _kind in (
    (0x00, 0x1F, "control"), (0x09, 0x0D, "break"), (0x20, 0x20, "blank"), (0x21, 0x7E, "symbol"), (0x7F, 0x7F, "control"),
    (0x30, 0x39, "digit"), (0x41, 0x5A, "upper"), (0x61, 0x7A, "lower"),
    (0xC2, 0xC9, "latin"), (0xCA, 0xDF, "two bytes"), (0xE0, 0xEF, "three bytes"), (0xF0, 0xF7, "four bytes"),
):
    _CLASS[_first : _last + 1] = CLASSES.index(_kind)
_CLASS[list(b".,;:!?'\"()-")] = CLASSES.index("stop")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
REFERENCE_SLICE = 16 << 20


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict."""

    common: int = 50
    min_words: int = 50
    min_chars: int = 200
    min_reference: int = 5_000
    min_share: float = 0.001
    max_class_distance: float = 0.32
    max_word_distance: float = 0.46
    base_min_words: int = 20
    base_repeat_percent: int = 30


def class_counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points by character class, a row for each text."""
    kind = _CLASS[raw]
    text = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(at))
    key = text * 256 + kind
    return np.bincount(key, minlength=256 * (len(at) - 1)).reshape(-1, 256)[:, : len(CLASSES)]


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row to the reference row beside it; 0 where either is empty."""
    total, whole = counts.sum(1, keepdims=True), reference.sum(1, keepdims=True)
    p, q = counts / np.maximum(total, 1), reference / np.maximum(whole, 1)
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = np.where(p > 0, p * np.log2(p / middle), 0).sum(1) + np.where(q > 0, q * np.log2(q / middle), 0).sum(1)
    return np.where((total[:, 0] > 0) & (whole[:, 0] > 0), np.sqrt(np.clip(apart / 2, 0, 1)), 0.0)


def _languages(table) -> list[str]:
    return [x if x is not None else "" for x in table.column("lang").to_pylist()]


def _counted(batches):
    """Rows (lang, word or null, count or class counts) of each slice."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for row, stop, raw, at in slices(table.column("text"), REFERENCE_SLICE):
            lang, names = pd.factorize(np.array(_languages(table.slice(row, stop - row)), object))
            classes = class_counts(raw, at)
            sums = np.zeros((len(names), len(CLASSES)), np.int64)
            np.add.at(sums, lang, classes)
            start, end, first = words(raw, at)
            codes, distinct = coded(pieces(raw, start, end))
            key = np.repeat(lang, np.diff(first)) * max(1, len(distinct)) + codes
            seen, n = np.unique(key, return_counts=True)
            of = pa.array(names[seen // max(1, len(distinct))].tolist(), pa.string())
            word = distinct.take(pa.array(seen % max(1, len(distinct)))).cast(pa.string()) if len(seen) else pa.array([], pa.string())
            yield from pa.table({"lang": of, "word": word, "n": pa.array(n, pa.int64()), "classes": pa.nulls(len(n), pa.list_(pa.int64()))}).to_batches()
            yield pa.record_batch([pa.array(names.tolist(), pa.string()), pa.nulls(len(names), pa.string()), pa.array(np.bincount(np.repeat(lang, np.diff(first)), minlength=len(names)), pa.int64()), pa.array(sums.tolist(), pa.list_(pa.int64()))], names=["lang", "word", "n", "classes"])


def references(docs: DataFrame, rules: Rules = Rules()) -> dict[str | None, tuple[list[int], dict[str, int], list[int]]]:
    """By language: class counts, the bins of the common words, and the counts of those bins (the last: other words).

    The pool of the small languages is under None. One pass over all texts counts both; words are summed before they are shuffled.
    """
    counted = docs.select("lang", "text").mapInArrow(_counted, "lang string, word string, n long, classes array<long>")
    summed = (
        counted.groupBy("lang", "word")
        .agg(F.sum("n").alias("n"), *[F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))])
    )
    sums = ["n", *[f"c{i}" for i in range(len(CLASSES))]]
    summed = materialize(summed, "words")
    totals = summed.where("word is null").select("lang", "n", F.sum("n").over(Window.partitionBy()).alias("whole"))  # a row for each language
    large = [r.lang for r in totals.where((F.col("n") >= rules.min_reference) & (F.col("n") >= rules.min_share * F.col("whole"))).collect()]
    pool = summed.where(~F.col("lang").isin(large)).groupBy("word").agg(*[F.sum(c).alias(c) for c in sums])
    summed = summed.where(F.col("lang").isin(large)).unionByName(pool.withColumn("lang", F.lit(None).cast("string")))
    first = Window.partitionBy("lang").orderBy(F.col("word").isNull().desc(), F.desc("n"), "word")
    top = summed.withColumn("place", F.row_number().over(first)).where(F.col("place") <= rules.common + 1)
    found = top.groupBy("lang").agg(
        F.max(F.when(F.col("word").isNull(), F.col("n"))).alias("total"),
        F.max(F.when(F.col("word").isNull(), F.array(*[f"c{i}" for i in range(len(CLASSES))]))).alias("classes"),
        F.sort_array(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("place", "word", "n")))).alias("words"),
    )
    out = {}
    for row in found.collect():
        n = [w.n for w in row.words]
        out[row.lang] = (list(row.classes), {w.word: i for i, w in enumerate(row.words)}, [*n, row.total - sum(n)])
    return out


def _duplicate_lines(raw: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    breaks = raw == 0x0A
    opens = np.zeros(len(raw) + 1, bool)
    opens[1:][breaks] = True
    opens[at[:-1]] = True
    opens[-1] = False
    begin = np.flatnonzero(opens)
    stop = np.append(begin[1:], len(raw)) if len(begin) else begin
    stop = stop - (breaks[stop - 1] if len(begin) else 0)
    worded = np.searchsorted(start, stop) > np.searchsorted(start, begin)
    begin, stop = begin[worded], np.maximum(stop, begin)[worded]
    text = np.searchsorted(at, begin, side="right") - 1
    if not len(begin):
        return np.zeros(len(at) - 1, np.int64)
    codes, distinct = coded(pieces(raw, begin, stop))
    again = pd.Series(text * len(distinct) + codes).duplicated().to_numpy()
    return np.bincount(text[again], minlength=len(at) - 1)


def _repeated_words(codes: np.ndarray, first: np.ndarray, width: int = 8) -> np.ndarray:
    """Words of each text in windows of eight words that the text holds twice or more."""
    n = len(codes)
    if n < width:
        return np.zeros(len(first) - 1, np.int64)
    key, m = codes.astype(np.int64), int(codes.max()) + 1
    step = 1
    while step < width:
        key, m = number(key[:-step] * m + key[step:])
        step *= 2
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begins = np.flatnonzero(text[: len(key)] == text[width - 1 :])
    again = pd.Series(text[begins] * m + key[begins]).duplicated(keep=False).to_numpy()
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, begins[again], 1)
    np.add.at(cover, begins[again] + width, -1)
    return per_text((np.cumsum(cover[:-1]) > 0).astype(np.int64), first)


def measured(docs: DataFrame, reference: dict, rules: Rules = Rules()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance.

    A distance is null where a guard holds it back.
    """
    bins = rules.common + 1

    def work(raw, at, rows):
        texts = len(at) - 1
        start, end, first = words(raw, at)
        n_words = np.diff(first)
        codes, distinct = coded(pieces(raw, start, end))
        names = distinct.cast(pa.string()).to_pylist() if len(distinct) else []
        points = (raw & 0xC0) != 0x80
        whole = class_counts(raw, at)
        lang, known = pd.factorize(np.array(_languages(rows), object))
        class_apart, word_apart = np.zeros(texts), np.zeros(texts)
        of_word = np.repeat(np.arange(texts), n_words)
        for k, name in enumerate(known):
            name = name if name in reference else None
            if name not in reference:
                class_apart[lang == k] = word_apart[lang == k] = np.nan
                continue
            classes, common, counts = reference[name]
            rows_k = np.flatnonzero(lang == k)
            class_apart[rows_k] = distance(whole[rows_k], np.tile(classes, (len(rows_k), 1)))
            place = np.fromiter((common.get(x, len(counts) - 1) for x in names), np.int64, len(names))
            histogram = np.bincount(of_word * bins + place[codes], minlength=texts * bins).reshape(texts, bins)[rows_k, : len(counts)] if len(codes) else np.zeros((len(rows_k), len(counts)))
            word_apart[rows_k] = distance(histogram, np.tile(counts, (len(rows_k), 1)))
        class_apart[whole.sum(1) < rules.min_chars] = np.nan
        word_apart[n_words < rules.min_words] = np.nan
        repeated = _repeated_words(codes, first)
        failed = (n_words < rules.base_min_words) | (100 * repeated > rules.base_repeat_percent * n_words)
        kept = ~failed & ~(class_apart > rules.max_class_distance) & ~(word_apart > rules.max_word_distance)
        return {
            "n_words": n_words, "word_chars": per_text((points & ~SPACE[raw]).astype(np.int64), at), "n_symbols": per_text(_SYMBOL[raw].astype(np.int64), at),
            "n_dup_lines": _duplicate_lines(raw, at, start), "n_repeat_words": repeated, "base_failed": failed, "kept": kept,
            "class_distance": pa.array(class_apart, from_pandas=True), "word_distance": pa.array(word_apart, from_pandas=True),
        }

    kinds = {k: pa.int64() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    kinds |= {"base_failed": pa.bool_(), "kept": pa.bool_(), "class_distance": pa.float64(), "word_distance": pa.float64()}
    sql = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{k} {sql[v]}" for k, v in kinds.items())
    return docs.select("doc_id", "lang", "text").mapInArrow(by_slice(kinds, work), schema)


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The verdict on every document against references counted over all of them."""
    return measured(docs, references(docs, rules), rules)
