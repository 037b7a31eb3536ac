"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features are the presence of single words, neighbouring pairs and pairs with one
word between them, hashed to ``2 ** bits`` places. Each coordinate has its own
learning rate; the L1 term keeps almost all weights at zero, so that the model
is a short list of places and weights which every scoring task is given.

The model is fitted on a bounded sample: of the labelled rows allowed for
training, the ``sample_rows`` with the smallest hash of their id. Scoring reads
every document whole.

Edge cases: a null or empty text has no features and gets the score of the bias;
labels that are null are left out, and a document labelled twice counts as toxic
if any label says so; without any usable label every score is 0.5; repeated rows
get equal scores; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.llm.batches import ASCII_LOWER, by_slice, coded, pieces, words

#: All ASCII but letters and digits parts words here.
_PART = np.ones(256, bool)
_PART[48:58] = _PART[65:91] = _PART[97:123] = _PART[128:] = False
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Settings:
    """Bounds and rates of the fit."""

    bits: int = 20
    sample_rows: int = 16_000
    epochs: int = 3
    toxic_weight: float = 5.0
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 1.0
    threshold: float = 0.7


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _B
        return x ^ (x >> np.uint64(29))


def features(raw: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every word, pair and skipping pair, repeats included."""
    raw = ASCII_LOWER[raw]
    start, end, first = words(raw, at, _PART)
    codes, distinct = coded(pieces(raw, start, end))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in distinct.to_pylist()), np.uint64, len(distinct))[codes] if len(codes) else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
    found = [(text, hashes)]
    for gap, salt in ((1, 1), (2, 2)):
        with np.errstate(over="ignore"):
            pair = hashes[:-gap] * _A + hashes[gap:] * np.uint64(2 * salt + 1) + np.uint64(salt)
        inside = text[:-gap] == text[gap:]
        found.append((text[:-gap][inside], pair[inside]))
    place = (_mixed(np.concatenate([x for _, x in found])) >> np.uint64(64 - bits)).astype(np.int64)
    return np.concatenate([x for x, _ in found]), place


def _present(raw: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places of all texts, and where each text's begin."""
    text, place = features(raw, at, bits)
    key = np.unique((text << bits) | place)
    return (key & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(key >> bits, np.arange(len(at)))


def fit(examples: list[tuple[np.ndarray, int]], settings: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Places, weights and bias after FTRL-proximal over the examples in their order."""
    size = 1 << settings.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(at):
        l1 = np.where(at == size, 0.0, settings.l1)
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2))

    for _ in range(settings.epochs):
        for places, label in examples:
            at = np.append(places, size)
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (settings.toxic_weight if label else 1.0)
            n_new = n[at] + g * g
            z[at] += g - (np.sqrt(n_new) - np.sqrt(n[at])) / settings.alpha * w
            n[at] = n_new
    w = weight(np.arange(size + 1))
    kept = np.flatnonzero(w[:-1])
    return kept, w[kept], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, allowed: Column, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, float]:
    """The model fitted on a bounded sample of the ``labels`` for which ``allowed`` holds."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & allowed)
    chosen = (
        usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label_"))
        .withColumn("order_", F.xxhash64("doc_id")).orderBy("order_", "doc_id").limit(settings.sample_rows)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("order_", "label_", "text")  # at most sample_rows rows of three numbers
    bits = settings.bits

    def placed(raw, at, _):
        places, first = _present(raw, at, bits)
        return {"places": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(places, pa.int32()))}

    def trained(batches):
        examples = []
        for batch in batches:
            lists = batch.column("places")
            flat, at = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            for k, (order, label) in enumerate(zip(batch.column("order_").to_pylist(), batch.column("label_").to_pylist())):
                examples.append((order, len(examples), flat[at[k] : at[k + 1]], label))
        examples.sort(key=lambda x: (x[0], x[3], len(x[2]), x[2].tobytes()))
        if len(examples):
            places, weights, bias = fit([(x[2], x[3]) for x in examples], settings)
            yield pa.record_batch([pa.array(np.append(places, -1), pa.int64()), pa.array(np.append(weights, bias), pa.float64())], names=["place", "weight"])

    shown = sample.mapInArrow(by_slice({"places": pa.list_(pa.int32())}, placed, "text", ("order_", "label_")), "order_ long, label_ int, places array<int>")
    rows = shown.repartition(1).mapInArrow(trained, "place long, weight double").collect()
    model = {r.place: r.weight for r in rows}
    bias = model.pop(-1, 0.0)
    return np.array(list(model), np.int64), np.array(list(model.values())), bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], settings: Settings = Settings()) -> DataFrame:
    """doc_id, score, predicted of every document."""
    places, weights, bias = model
    bits = settings.bits

    def work(raw, at, _):
        dense = np.zeros(1 << bits)
        dense[places] = weights
        text, place = features(raw, at, bits)
        hit = dense[place] != 0
        key = np.unique((text[hit] << bits) | place[hit])
        total = np.bincount(key >> bits, dense[key & ((1 << bits) - 1)], minlength=len(at) - 1) + bias
        out = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
        return {"score": out, "predicted": (out >= settings.threshold).astype(np.int32)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(by_slice({"score": pa.float64(), "predicted": pa.int32()}, work), f"doc_id {kind}, score double, predicted int")
