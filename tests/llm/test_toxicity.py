"""Held-out accuracy, and what odd rows get."""

from pyspark.sql import functions as F

from cutline.llm import toxicity as X
from cutline.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out(spark):
    found = QUERIES["op5_toxicity_ftrl"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic, clean = found[found.toxic == 1], found[found.toxic == 0]
    above = (toxic.score.to_numpy()[:, None] > clean.score.to_numpy()[None, :]).mean()
    assert above > 0.97
    assert clean.predicted.mean() < 0.01
    assert toxic.predicted.mean() > 0.6
    assert (found.predicted == (found.score >= 0.7)).all()


def test_odd_rows(spark):
    rows = [(1, "you vile thing", 9), (2, "a kind thing", 9), (3, None, 9), (4, "", 9), (5, "vile " * 30_000, 9), (2, "a kind thing", 9), (None, "vile", 9)]
    docs = spark.createDataFrame(rows * 1, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (5, 1)], "doc_id long, toxic int")
    settings = X.Settings(l1=0.01, alpha=1.0, epochs=20)
    scored = X.score(docs, X.train(docs, labels, F.lit(True), settings), settings).collect()
    by_id = {}
    for r in scored:
        by_id.setdefault(r.doc_id, set()).add(round(r.score, 12))
        assert 0 <= r.score <= 1
    assert len(scored) == len(rows) and all(len(v) == 1 for v in by_id.values())
    assert by_id[3] == by_id[4] and max(by_id[1]) > max(by_id[2])
    unlabelled = X.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in X.score(docs, unlabelled).collect()} == {0.5}
    assert X.score(docs.limit(0), unlabelled).count() == 0
