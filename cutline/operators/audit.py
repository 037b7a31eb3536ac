"""Display reads over finished runs, and the leakage audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline import constants as K
from cutline.functions import distributions as D
from cutline.operators import timeline as TL
from cutline.operators.scalars import with_row

SORTS = {"err": "abs_error", "proj": "projected_value", "wk": "week", "n": "n_eff"}


def filtered(predictions: DataFrame, *, cohort: str | None = None, entity=None) -> DataFrame:
    out = predictions
    if cohort is not None:
        out = out.where(F.array_contains("cohorts", cohort))
    if entity is not None:
        out = out.where(F.col("entity_id") == entity)
    return out


def top_predictions(predictions: DataFrame, *, cohort: str | None = None, entity=None, sort: str = "err", limit: int = 50) -> DataFrame:
    """The report's top rows, each carrying how many matched and how many exist.

    The limit is the report's; filters see every prediction.
    """
    total = predictions.agg(F.count("*").alias("total"))
    matching = filtered(predictions, cohort=cohort, entity=entity)
    shown = matching.orderBy(F.desc(SORTS.get(sort, "abs_error")), F.asc("prediction_id")).limit(limit)
    counts = matching.agg(F.count("*").alias("filtered"))
    return with_row(with_row(shown, counts), total)


def exclusion_examples(exclusions: DataFrame, reason: str, limit: int = 12) -> DataFrame:
    matching = exclusions.where(F.col("reason") == reason)
    counts = matching.agg(F.count("*").alias("examples_total"))
    shown = matching.orderBy("event_id", "entity_id", "measure").limit(limit)
    return with_row(shown, counts)


def grid_probabilities(predictions: DataFrame, registry: DataFrame, at: float | None = None) -> DataFrame:
    """P(X >= t) from stored parameters alone, on the grid or at one threshold."""
    joined = predictions.select("prediction_id", "measure", "distribution_kind", "params").join(
        F.broadcast(registry.select("measure", "thresholds")), "measure"
    )
    wanted = F.array(F.lit(float(at))) if at is not None else F.col("thresholds")
    tall = joined.select("*", F.explode(wanted).alias("threshold"))
    return tall.select(
        "prediction_id", "measure", "threshold", D.at_least(F.col("distribution_kind"), F.col("params"), F.col("threshold")).alias("probability"),
        F.array_contains("thresholds", F.col("threshold")).alias("in_grid"),
    )


def latest_visible(targets: DataFrame, observations: DataFrame, keys: list[str],
                   bucket_seconds: int = TL.DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """The newest record per target and source that its cutoff could see.

    A target asks once for each source that its keys have any record of;
    sources it saw nothing of have no row.
    """
    held = observations.select(*keys, "source").distinct()
    asked = targets.select("target_id", *keys, "cutoff").join(held, keys)
    right = observations.select(*keys, "source", "known_at", "value").withColumn("value_known_at", F.col("known_at"))
    out = TL.asof_latest(asked, right, [*keys, "source"], "cutoff", "known_at", ["value", "value_known_at"], right_order=["value"],
                         bucket_seconds=bucket_seconds)
    return out.where(F.col("value_known_at").isNotNull()).select("target_id", "source", "value", F.col("value_known_at").alias("known_at"))


def hidden_records(targets: DataFrame, facts: DataFrame, context: DataFrame, limit: int = K.EXCLUDED_SAMPLE,
                   bucket_seconds: int | None = None) -> DataFrame:
    """Per target, the first records its cutoff hides: facts, then context fills up.

    ``targets``: target_id, entity_id, cutoff. ``facts`` and ``context``:
    entity_id, record_id, known_at, detail. Without ``bucket_seconds`` timelines are split
    by time only where an entity has many rows.
    """
    if bucket_seconds is None:
        bucket_seconds = TL.suggest_width([(targets, "cutoff"), (facts, "known_at"), (context, "known_at")], ["entity_id"])
    def after(rows: DataFrame, kind: str, room: Column, asked: DataFrame) -> DataFrame:
        found = TL.next_rows(asked, rows.select("entity_id", "record_id", "known_at", "detail"), ["entity_id"], "cutoff", "known_at",
                             ["record_id"], room, bucket_seconds=bucket_seconds)
        return found.select("target_id", F.lit(kind).alias("kind"), "nth", "record_id", "known_at", "detail")

    base = targets.select("target_id", "entity_id", "cutoff")
    sizes = facts.groupBy("entity_id").agg(F.count("*").alias("n_facts"))
    one = facts.select("entity_id", F.col("known_at").alias("at"), F.lit(1).alias("passed"))
    placed = TL.asof_totals(base, one, ["entity_id"], "cutoff", "at", ["passed"], bucket_seconds=bucket_seconds)
    left = placed.join(sizes, "entity_id", "left").withColumn(
        "room", F.greatest(F.lit(limit) - (F.coalesce("n_facts", F.lit(0)) - F.col("passed")), F.lit(0))
    ).drop("n_facts", "passed")
    stats = after(facts, "fact", F.lit(limit), base)
    rest = after(context, "context", F.col("room"), left)
    return stats.unionByName(rest)


def explain(prediction_id: str, predictions: DataFrame, registry: DataFrame, observations: DataFrame,
            facts: DataFrame, context: DataFrame) -> dict[str, DataFrame]:
    """Everything the explain report shows of one prediction, as frames.

    ``observations``: entity_id, event_id, source, known_at, value.
    """
    row = predictions.where(F.col("prediction_id") == prediction_id)
    asked = row.select(F.col("prediction_id").alias("target_id"), "entity_id", "event_id", "cutoff")
    return {
        "row": row.withColumn("cutoff_at_or_after_kickoff", F.col("cutoff") >= F.col("valid_at")),
        "grid": grid_probabilities(row, registry),
        "visible": latest_visible(asked, observations, ["entity_id", "event_id"]),
        "hidden": hidden_records(asked.drop("event_id"), facts, context),
    }
