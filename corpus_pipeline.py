"""Cleaning and packing of a corpus: each stage works on what its predecessor kept.

Every stage takes (spark, docs, sf_dir), is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm import packing, secrets, simhash, suffix, toxicity
from cutline.llm.queries import table, vocabulary
from cutline.llm.rows import numbered, restored
from cutline.session import materialize, shipped

#: SQL has no form for these stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject. The model learns from the labels of all documents but the held-out third."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    rows = numbered(docs)
    rejected = toxicity.score(rows, model).where("predicted = 1").select("doc_id")
    return restored(rows.join(rejected, "doc_id", "left_anti"), docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the first in the order of ids (of equal ids, of texts)."""
    rows = numbered(docs)
    first = simhash.near_copies(rows).where("doc_id = component_id").select("doc_id")
    return restored(rows.join(first, "doc_id", "left_semi"), docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text without the passages of 100 bytes or more that occur earlier; ``n_chars`` follows."""
    return _with_text(docs, suffix.cut_rows(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret masked; ``n_chars`` follows."""
    masked = secrets.redacted(docs, letters=True)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining texts as pieces in sequences of 1024 tokens."""
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"), added=True)


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


STAGES = [
    ("toxicity", shipped(toxicity_filter)),
    ("simhash_near_dedup", shipped(simhash_near_dedup)),
    ("suffix_array_dedup", shipped(suffix_array_dedup)),
    ("secret_scan", shipped(secret_scan)),
    ("best_fit_packing", shipped(best_fit_packing)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
