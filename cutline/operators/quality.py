"""Data-quality rules as counted filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule with its violation count, all in a single pass.

    A rule is the predicate a good row satisfies; NULL counts as satisfied, as
    it does in a CHECK constraint.
    """
    counted = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(True))).alias(name) for name, ok in rules.items()])
    pairs = ", ".join(f"'{n}', `{n}`" for n in rules)
    return counted.select(F.expr(f"stack({len(rules)}, {pairs}) as (rule, violations)"))


def duplicate_keys(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Rows beyond the first of each key."""
    per = df.groupBy(*keys).agg((F.count("*") - 1).alias("extra"))
    return per.agg(F.lit(rule).alias("rule"), F.coalesce(F.sum("extra"), F.lit(0)).cast("long").alias("violations"))


def not_in_set(df: DataFrame, column: str, allowed: list[str], rule: str) -> DataFrame:
    return violations(df, {rule: F.col(column).isin(*allowed)})


def known_after_valid() -> Column:
    return F.col("known_at") >= F.col("valid_at")


def resolved_has_entity() -> Column:
    settled = F.col("status").isin("resolved", "manual_override")
    return settled == F.col("entity_id").isNotNull()


def dome_has_no_weather() -> Column:
    measured = F.col("temperature_c").isNotNull() | F.col("wind_kph").isNotNull() | F.col("precipitation_mm").isNotNull()
    return ~((F.col("status") == "dome") & measured)


def bin_is_sane() -> dict[str, Column]:
    axes = F.col("stat_type").isNotNull().cast("int") + F.col("season").isNotNull().cast("int") + F.col("era").isNotNull().cast("int")
    return {
        "bin_bounds": (F.col("bin_low") >= 0) & (F.col("bin_high") <= 1) & (F.col("bin_low") < F.col("bin_high")),
        "bin_sizes": F.col("projection_count") <= F.col("threshold_observations"),
        "single_axis": (axes + (F.col("population").isNotNull() & F.col("stat_type").isNull()).cast("int")) <= 1,
    }


def run_is_sane() -> dict[str, Column]:
    total = F.col("projected_count") + F.col("unprojectable_count") + F.col("excluded_count")
    digests = F.col("predictions_digest").isNotNull() & F.col("aggregate_digest").isNotNull() & F.col("calibration_digest").isNotNull()
    return {
        "population_reconciles": total == F.col("candidate_count"),
        "completed_has_digests": (F.col("status") != "completed") | digests,
    }
