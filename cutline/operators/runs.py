"""Run records: listings, expectations and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline import constants as K
from cutline.functions import market as M
from cutline.functions import rows as RW
from cutline.functions import times
from cutline.operators import timeline as TL
from cutline.operators.scalars import with_row


def list_runs(runs: DataFrame, *, model_version: str | None = None, evaluation_window: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest first; the id breaks ties."""
    out = runs
    if model_version is not None:
        out = out.where(F.col("model_version") == model_version)
    if evaluation_window is not None:
        out = out.where(F.col("evaluation_window") == evaluation_window)
    out = out.orderBy(F.desc("started_at"), F.desc("run_id"))
    return out.limit(limit) if limit is not None else out


def holdout_model_versions(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("evaluation_window") == "holdout").select("model_version").distinct()


def upcoming_season_window(events: DataFrame, now: Column) -> DataFrame:
    """(season_from, season_to) of scheduled events in the lookahead; NULLs if none."""
    ahead = times.kicks_off_within(F.col("kickoff_at"), now, minutes=K.SEASON_LOOKAHEAD_DAYS * 1440)
    return events.where((F.col("status") == "scheduled") & ahead).agg(F.min("season").alias("season_from"), F.max("season").alias("season_to"))


def window_events(events: DataFrame, now: Column, minutes: int = K.GAMEDAY_WINDOW_MINUTES) -> DataFrame:
    due = (F.col("status") == "scheduled") & times.kicks_off_within(F.col("kickoff_at"), now, minutes=minutes)
    return events.where(due).orderBy("kickoff_at", "event_id")


def sync_attempts(syncs: DataFrame) -> DataFrame:
    """Market syncs in the shape of run attempts (category price_refresh)."""
    return syncs.select(
        "run_id", F.lit("price_refresh").alias("category"),
        RW.attempt_status(F.col("status"), F.col("finished_at")).alias("status"), "started_at", "finished_at",
    )


def expectations(events: DataFrame, now: Column) -> DataFrame:
    """One row: is anything upcoming, and is a kickoff within the price window."""
    scheduled = events.where(F.col("status") == "scheduled")
    in_week = times.upcoming_within(F.col("kickoff_at"), now, hours=K.SEASON_LOOKAHEAD_DAYS * 24)
    in_window = times.upcoming_within(F.col("kickoff_at"), now, hours=K.GAMEDAY_PRICE_WINDOW_HOURS)
    return scheduled.agg(
        F.coalesce(F.max(in_week), F.lit(False)).alias("expected"), F.coalesce(F.max(in_window), F.lit(False)).alias("gameday")
    )


def health_signals(attempts: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """State per signal from the latest attempt and the latest success.

    ``attempts``: run_id, category, status, started_at, finished_at.
    """
    spark = attempts.sparkSession
    late = spark.createDataFrame(
        [("ingest", K.INGEST_LATE_AFTER_HOURS * 60), ("recompute", K.RECOMPUTE_LATE_AFTER_HOURS * 60), ("price_refresh", None)],
        "category string, late_after int",
    )
    per = attempts.groupBy("category").agg(
        F.max_by(F.struct("status", "started_at", "finished_at"), F.struct("started_at", "run_id")).alias("a"),
        F.max(F.when(F.col("status") == "succeeded", F.col("finished_at"))).alias("last_success_at"),
    )
    cadence = F.when(F.col("gameday"), K.PRICE_GAMEDAY_CADENCE_MINUTES).otherwise(K.PRICE_IN_WEEK_CADENCE_MINUTES)
    joined = with_row(late, expectations(events, now)).join(per, "category", "left")
    joined = joined.withColumn("late_after", F.coalesce("late_after", cadence * K.PRICE_LATE_CADENCE_MULTIPLIER))
    state = M.signal_state(F.col("expected"), F.col("a")["status"], F.col("a")["started_at"], F.col("last_success_at"), F.col("late_after"), now)
    return joined.select(
        "category", state.alias("state"), F.col("a")["status"].alias("last_attempt_outcome"),
        F.coalesce(F.col("a")["finished_at"], F.col("a")["started_at"]).alias("last_attempt_at"), "last_success_at",
        times.age_label(F.col("last_success_at"), now).alias("last_success_age"),
    )


def source_detail(source_runs: DataFrame) -> DataFrame:
    """Per-source states of each cycle, only for cycles with a source not ok."""
    state = F.when(F.col("status") == "success", "ok").when(F.col("status") == "failed", "failed").otherwise("degraded")
    rows = source_runs.select("cycle_id", F.col("dataset").alias("source"), F.col("dataset").isin(*K.REQUIRED_SOURCES).alias("required"), state.alias("state"))
    bad = rows.where(F.col("state") != "ok").select("cycle_id").distinct()
    return rows.join(bad, "cycle_id", "left_semi")


def lagging_events(outcomes: DataFrame, events: DataFrame) -> DataFrame:
    """Events a recompute cycle left behind, with the cycle's counts."""
    counts = outcomes.groupBy("cycle_id").agg(
        F.count("*").alias("total_count"), F.sum((F.col("status") == "succeeded").cast("long")).alias("current_count")
    )
    reason = F.when(F.col("status") == "failed", "failed this cycle").otherwise("not recomputed this cycle")
    label = events.select("event_id", "kickoff_at", F.concat_ws(" @ ", "away_team", "home_team").alias("label"))
    behind = outcomes.where(F.col("status") != "succeeded").select("cycle_id", "event_id", reason.alias("reason"))
    return behind.join(label, "event_id").join(counts, "cycle_id")


def detail_cycle(runs: DataFrame, now: Column) -> DataFrame:
    """Latest run per category, unless it is still legitimately running."""
    last = TL.latest_per_key(runs, ["category"], ["started_at", "run_id"])
    fresh = (F.col("status") == "running") & ((F.unix_millis(now) - F.unix_millis("started_at")) / 60000.0 <= K.RUN_TIMEOUT_MINUTES)
    return last.where(~fresh)


def health_rollup(attempts: DataFrame, source_runs: DataFrame, outcomes: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Each signal with its state, and what its latest settled cycle left wrong: the worst source and the events it left behind.

    ``attempts`` as for :func:`health_signals`; ``source_runs``: cycle_id, dataset, status;
    ``outcomes``: cycle_id, event_id, status. Required sources are worse than others, failed ones
    worse than degraded ones. Each log is summed by cycle in one pass, by conditional maxima; nothing is ranked or gathered.
    """
    cycle = detail_cycle(attempts, now).select("category", F.col("run_id").alias("cycle_id"))
    state = F.when(F.col("status") == "success", "ok").when(F.col("status") == "failed", "failed").otherwise("degraded")
    runs = source_runs.select("cycle_id", F.col("dataset").alias("source"), F.col("dataset").isin(*K.REQUIRED_SOURCES).alias("required"), state.alias("state"))
    bad = F.col("state") != "ok"
    sources = runs.groupBy("cycle_id").agg(
        F.count("*").alias("source_count"), F.count_if(bad).alias("source_bad"),
        F.max_by(F.struct("source", "state", "required"), F.when(bad, F.struct("required", F.col("state") == "failed", "source"))).alias("worst"),
    )
    behind = F.col("status") != "succeeded"
    left = outcomes.join(events.select("event_id", "kickoff_at"), "event_id").groupBy("cycle_id").agg(
        F.count("*").alias("event_count"), F.count_if(behind).alias("event_behind"),
        F.min_by("event_id", F.when(behind, F.struct("kickoff_at", "event_id"))).alias("first_behind"),
    )
    told = cycle.join(sources, "cycle_id", "left").join(left, "cycle_id", "left")
    told = told.select("category", "cycle_id", "source_count", "source_bad", "worst.*", "event_count", "event_behind", "first_behind").withColumnsRenamed(
        {"source": "worst_source", "state": "worst_state", "required": "worst_required"}
    )
    return health_signals(attempts, events, now).join(told, "category", "left")
