"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from cutline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    draw = random.Random(3)
    letters = "ab ,.'s\n\t é中 　 x1９🙂!?tlledrevm"
    out = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 300))) for _ in range(150)]
    return out + ["", " " * 900, "a" * 3000, "ab" * 700, "The's don't 'LL<|endoftext|> " * 30, "in, the. end", "word " * 5000]


def test_round_trip(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(900, None, "x"), (901, "twice", None), (901, "twice", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect())
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert found == sorted(want)


def test_encode_then_decode(spark, library):
    docs = spark.createDataFrame([(1, "Ünïcode and  spaces"), (2, None), (3, "")], "doc_id long, text string")
    ids = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    assert {r.doc_id: r.ids for r in ids.collect()} == {1: library.encode_ordinary("Ünïcode and  spaces"), 2: [], 3: []}
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decode(ids, PATH, public_tokenizers.PATTERN).collect()} == {1: "Ünïcode and  spaces".encode(), 2: b"", 3: b""}
    assert bpe.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_rounds_and_heap_agree():
    held = bpe.ranks(PATH, public_tokenizers.PATTERN)
    piece = b"internationalisation" * 12
    by_rounds, _ = held.merge([piece])
    assert list(by_rounds) == held._heap(held.single[np.frombuffer(piece, np.uint8)].tolist())
