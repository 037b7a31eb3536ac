"""Each stage on its own input, against plain Python."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cutline.llm import toxicity
from tests.llm import test_packing as packing_test
from tests.llm import test_secrets as secrets_test
from tests.llm import test_simhash as simhash_test
from tests.llm.test_suffix import brute as without_repeats

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert docs.columns == out["documents"].columns
        out[name] = docs
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_toxicity(spark, kept):
    docs = kept["documents"]
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~held_out)
    rejected = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    assert set(rows(kept["toxicity"])) == set(rows(docs)) - rejected


def test_near_copies(kept):
    groups = simhash_test.brute(list(rows(kept["toxicity"]).items()))
    assert set(rows(kept["simhash_near_dedup"])) == {c for _, _, c in groups}


def test_repeats(kept):
    before, after = rows(kept["simhash_near_dedup"]), rows(kept["suffix_array_dedup"])
    assert before.keys() == after.keys()
    gone = {r[0]: r[2] for r in without_repeats(sorted(before.items()))}
    for i in before:
        lost = len(before[i].encode()) - len(after[i].encode())
        assert gone[i] - 6 * 20 <= lost <= gone[i]
    assert sum(gone.values()) > 0


def test_masked_secrets(kept):
    before, after = rows(kept["suffix_array_dedup"]), rows(kept["secret_scan"])
    for i in before:
        found = secrets_test.base(before[i]) + secrets_test.entropy(before[i])
        assert ("[SECRET]" in after[i]) == bool(found) or "[SECRET]" in before[i]
    assert {r.doc_id: r.n_chars for r in kept["secret_scan"].collect()} == {i: len(t) for i, t in after.items()}


def test_packing_and_run(spark, kept):
    docs = kept["secret_scan"]
    found = STAGES["best_fit_packing"](spark, docs, SF).collect()
    packing_test.check(found, list(rows(docs).items()))
    again = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in found)


def test_repeated_and_missing_ids(spark):
    text = " ".join(f"word{i}" for i in range(40))
    given = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text + ".", "en", "a", 1), (None, None, None, None, None), (2, "", "en", "a", 0)]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        if name == "simhash_near_dedup":
            assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) in ([(1, text), (2, "")], [(1, text), (2, ""), (None, text + ".")])
    assert STAGES["best_fit_packing"](spark, docs, SF).count() >= 2
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
