"""Connected components of a link table, by alternating stars.

Each round points a node's larger neighbours at its least neighbour and then the
node itself, so that the trees flatten in a logarithmic number of rounds. Links
are summed per node before any shuffle and stored in the shared folder after
each round; nothing of them reaches the driver but a count and a hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.session import materialize


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): the root is the least node reachable. Loops and repeats do no harm."""
    links = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        large = materialize(large, "links")
        small = large.join(_least(large), "a")
        small = small.select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        links = materialize(small, "links")
        now = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == seen:
            break
        seen = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
