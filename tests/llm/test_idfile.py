"""Shards read back against the library; the perfect hash against its definition."""

import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cutline.llm import idfile as I
from cutline.llm.vocab import Library
from cutline.session import checkpoint_dir

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    held = Tokenizer.from_file(path)
    held.encode_special_tokens = True
    return held


def texts():
    draw = random.Random(8)
    letters = "ab ,.'s\n\t é中 　 x1９🙂!?tlled|Ñé"
    out = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 200))) for _ in range(150)]
    return out + ["", " | ", "a|b", "x\ny", "<|endoftext|> <|startoftext|>", "It's THE end. Café, naïve.", "w " * 20_000, "z" * 2_000]


@pytest.mark.parametrize("path, kind", [(WORD, "word"), (BYTE, "byte")])
def test_units_encode_like_whole_texts(path, kind):
    from cutline.llm.batches import flat
    import pyarrow as pa

    held, plain = Library(path, kind), library(path)
    ids, first = held.with_end(*flat(pa.array(texts())), 2)
    for text, a, b in zip(texts(), first, first[1:]):
        assert ids[a:b].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2], text


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000))
    held = I.PerfectHash.build(keys)
    assert sorted(held.slots(keys)) == list(range(len(keys)))
    assert len(held.words) * 64 < 4.2 * len(keys)
    assert I.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]


def test_stored_and_read_back(spark):
    rows = [(k * 3 - 50, t, "x") for k, t in enumerate(texts())] + [(900, None, "y"), (901, "b twice", "y"), (901, "a twice", "y"), (None, "no id", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(6)
    found = [tuple(r) for r in I.stored(docs, WORD, "word", 2).collect()]
    plain, at, want = library(WORD), 0, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(found, key=str) == sorted(want, key=str)


def test_keyed_access(spark):
    docs = spark.createDataFrame([(i * 7, f"text number {i}") for i in range(300)], "doc_id long, text string")
    folder = f"{checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    manifest = I.write(docs, WORD, "word", 2, folder, shards=3).collect()
    plain, foreign = library(WORD), 0
    for row in manifest:
        shard = I.Shard(folder, row.name)
        for key in shard.docs[:20]:
            place, many = shard.find(np.array([key]))
            assert many[0] == 1 and shard.ids(int(place[0])).tolist() == [*plain.encode(f"text number {key // 7}", add_special_tokens=False).ids, 2]
        foreign += int((shard.find(np.arange(300) * 7 + 3)[1] > 0).sum())
    assert sum(r.docs for r in manifest) == 300 and foreign == 0
    assert I.stored(docs.limit(0), WORD, "word", 2).count() == 0
    with pytest.raises(ValueError):
        I.write(spark.createDataFrame([("a", "b")], "doc_id string, text string"), WORD, "word", 2, folder)
