"""Pieces against the library; sequences against their definition and a best-fit count."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cutline.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


def check(rows, docs):
    held = Tokenizer.from_file(PATH)
    held.encode_special_tokens = True
    want = []
    for i, text in docs:
        ids = [*held.encode(text or "", add_special_tokens=False).ids, 2]
        short = len(ids) - (-(-len(ids) // 1024) - 1) * 1024
        cuts = [0, *range(short, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held_ in sequences.values():
        at = 0
        for offset, length in sorted(held_):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences), [r.length for r in rows]


def best_fit(lengths):
    room = []
    for n in sorted(lengths, reverse=True):
        k = min((k for k in range(len(room)) if room[k] >= n), key=lambda k: room[k], default=None)
        if k is None:
            room.append(1024 - n)
        else:
            room[k] -= n
    return len(room)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    used, lengths = check(P.packed(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert used <= best_fit(lengths)
    assert used <= -(-sum(lengths) // 1024) * 1.01 + 1


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 1023), (4, "word " * 5000), (5, "same"), (5, "same"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, length int")
    check(P.packed(docs, PATH).collect(), rows)
    assert P.packed(docs.limit(0), PATH).count() == 0


def test_plan_holds_the_histogram():
    draw = np.random.default_rng(2)
    counts = np.zeros(1025, np.int64)
    counts[draw.integers(1, 1025, 300)] = draw.integers(1, 5000, 300)
    made = P.plan(counts, 1024)
    back = np.zeros(1025, np.int64)
    for chosen, many in made:
        assert sum(chosen) <= 1024 and many > 0
        np.add.at(back, list(chosen), many)
    assert (back == counts).all()
    assert sum(m for _, m in made) <= sum(m for _, m in P.best_fit(counts, 1024))


def test_best_fit_in_groups():
    counts = np.zeros(1025, np.int64)
    counts[np.random.default_rng(3).integers(1, 1025, 200)] += np.random.default_rng(4).integers(1, 9, 200)
    lengths = np.repeat(np.arange(1025), counts).tolist()
    assert abs(sum(m for _, m in P.best_fit(counts, 1024)) - best_fit(lengths)) <= 2


def test_knapsack():
    lengths = np.array([3, 5, 7])
    assert sorted(P.knapsack(np.array([3.0, 5.0, 7.1]), lengths, 17)) in ([3, 7, 7],)
    assert P.knapsack(np.array([1.0, 1.0, 1.0]), lengths, 2) == []
