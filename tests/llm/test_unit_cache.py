"""The unit cache gives what its encoder gives, however often it is emptied and whatever its hashes."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cutline.llm import batches as B


def encode(units):
    ids = [list(x) for x in units]
    return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)


@pytest.mark.parametrize("most,hashed", [(400_000, None), (20, None), (20, lambda raw, at: np.zeros(len(at) - 1, np.uint64)), (400_000, lambda raw, at: (np.arange(len(at) - 1) % 3).astype(np.uint64))])
def test_units_come_back(monkeypatch, most, hashed):
    if hashed:
        monkeypatch.setattr(B, "_unit_keys", hashed)  # units that share a hash
    draw = random.Random(1)
    cache = B.UnitCache(encode, most)
    words = ["", "a", "bc", "é", "def,", "x" * 300, *(f"w{i}" for i in range(40))]
    for _ in range(12):
        texts = [" ".join(draw.choices(words, k=draw.randint(0, 30))) for _ in range(20)] + [None, ""]
        raw, at = B.flat(pa.array(texts))
        ids, first = cache.ids(raw, at)
        for k, text in enumerate(texts):
            assert bytes(ids[first[k] : first[k + 1]].astype(np.uint8)) == (text or "").encode()
    assert cache.young.ids.count <= most + 500


def test_equal_units_have_equal_hashes():
    raw, at = B.flat(pa.array(["ab", "cab", "ab", "", "abc"]))
    keys = B._unit_keys(raw, at)
    assert keys[0] == keys[2] and len(set(keys.tolist())) == 4
