"""Texts that hold the content of added tokens, against a plain call of the library."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cutline.llm import queries as Q
from cutline.llm.batches import flat
from cutline.llm.vocab import Library

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
#: The last two meet only where one text ends and the next begins.
TEXTS = ["<|endoftext|>", "a  <|endoftext|> b", "plain text, here.", "x\n <|startoftext|><|endoftext|>é  ", "<|ENDOFTEXT|> <|endoftext", "", "Ends in <|endof", "text|> begins"]


@pytest.mark.parametrize("path, kind", [(WORD, "word"), (BYTE, "byte")])
def test_library(path, kind):
    plain = Tokenizer.from_file(path)
    ids, first = Library(path, kind, added=True).with_end(*flat(pa.array(TEXTS)), 2)
    for text, a, b in zip(TEXTS, first, first[1:]):
        assert ids[a:b].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2], text


def test_queries_and_pipeline(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    crcs = lambda path: [(i, zlib.crc32(np.array([*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in enumerate(TEXTS)]
    of = lambda rows: sorted((r.doc_id, r.ids_crc32) for r in rows.collect())
    assert of(Q.op8_id_shards(spark, str(tmp_path))) == crcs(WORD)
    assert of(Q.op9_configuration_packing(spark, str(tmp_path))) == crcs(BYTE)
    assert of(corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path))) == crcs(BYTE)
