"""Documents whose ids may repeat or be missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.session import materialize


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, given, row_): unique ids in the order of the rows; ``given`` is the id they came with, ``row_`` all other columns."""
    others = F.struct(*[c for c in docs.columns if c != "text"]).alias("row_")
    seen = docs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if seen.rows == seen.ids and docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int"):
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("doc_id").alias("given"), others)
    keys = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    ranged = docs.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(ranged.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.col("doc_id").alias("given"), others), "numbered")


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Numbered rows with the columns that ``docs`` has."""
    return rows.select("text", "row_.*").select(docs.columns)
