"""Ranked search against brute force: scores, ties, copies, odd texts, several blocks and shards."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cutline.llm import lexical as L

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(terms(text))
    out = []
    for item, words in asked.items():
        scored = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if score > 0:
                scored.append((-score, i is None, i, score))
        out += [(item, rank, i, s) for rank, (_, _, i, s) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(n):
        size = draw.choice([1, 3, 20, 200])
        docs.append((i, " ".join(draw.choices(vocabulary, weights=[1 / (j + 1) for j in range(300)], k=size))))
    docs[::3] = [(i, docs[0][1]) for i, _ in docs[::3]]  # a third are copies
    items = [(j, " ".join(draw.choices(vocabulary, k=draw.choice([1, 4, 30])))) for j in range(40)]
    return docs, items


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("settings", [L.Settings(), L.Settings(shard_docs=16, shard_postings=100, block_terms=50, first_read=1, bits=64), L.Settings(shard_docs=50, first_read=3)])
def test_against_brute_force(spark, settings):
    docs, items = corpus(1, 400)
    got = L.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), settings=settings)
    assert found(got) == brute(docs, items)


ODD_DOCS = [
    (1, None), (2, ""), (3, " \t\n.,;"), (4, "Ärger ärger ÄRGER"), (5, "a b a"), (6, "x" * 200_000), (7, "word " * 60_000), (8, "Word"), (8, "word"), (None, "word"), (9, "wİrd KK"), (10, "a_b-c9d"),
    (11, "日本語 日本語"), (12, "word word"), (12, "word word"), (None, None), (13, "don't stop"), (-4, "word"),
]
ODD_ITEMS = [(1, "word WORD"), (2, None), (3, "nothing here"), (4, "ärger Ärger"), (5, "a b"), (5, "c9d stop"), (6, ""), (7, "x" * 200_000), (None, "word 日本語"), (8, "wİrd kK"), (9, ". , ;")]


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, 1.0, "q") for i, t in ODD_DOCS], "doc_id long, text string, score double, q string")
    items = spark.createDataFrame([(i, t, 1) for i, t in ODD_ITEMS], "item_id long, text string, doc_id int")
    for settings in (L.Settings(), L.Settings(shard_docs=2, first_read=1)):
        assert found(L.search(docs, items, settings=settings)) == brute(ODD_DOCS, ODD_ITEMS)
    assert L.search(docs.limit(0), items).count() == 0 and L.search(docs, items.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None), (2, "--")], "doc_id long, text string")
    assert L.search(empty, items).count() == 0


def test_reading_stops_early():
    """A strong bound ends the reading; without one every interval closes exactly."""
    draw = np.random.default_rng(2)
    lists = []
    for n in (4_000, 3_000, 500, 20):
        doc = draw.permutation(5_000)[:n]
        lists.append((doc, -np.sort(-draw.integers(1, 1_000_000, n))))
    total = np.zeros(5_000, np.int64)
    for doc, impact in lists:
        total[doc] += impact
    order = np.lexsort((np.arange(5_000), -total))[:10]
    doc, score = L.resolve(lists, np.arange(5_000), 10, 1, 16)
    assert list(doc) == list(order) and (score == total[order]).all()
    doc, score = L.resolve(lists, np.arange(5_000), 10, int(total[order[2]]), 16)
    assert list(doc) == [d for d in order if total[d] >= total[order[2]]]
    assert not len(L.resolve(lists, np.arange(5_000), 10, 10_000_000, 16)[0])


def test_bits_depend_on_the_bytes_alone():
    raw = np.frombuffer("one two one ærlig two".encode(), np.uint8)
    raw, start, stop, _ = L._terms(raw, np.array([0, len(raw)]))
    bit = L.word_bits(raw, start, stop, 1 << 22)
    assert bit[0] == bit[2] and bit[1] == bit[4] and len(set(bit)) == 3
