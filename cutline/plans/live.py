"""Live projection of contract-listed entities at one cutoff."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline import constants as K
from cutline.operators import history as H
from cutline.operators import market as MK
from cutline.operators import merges as MG
from cutline.operators import priors as P
from cutline.operators import projection as PJ
from cutline.operators import runs as R
from cutline.session import materialize


@dataclass(frozen=True)
class LiveRun:
    projections: DataFrame
    drivers: DataFrame
    outcomes: DataFrame
    declined: DataFrame


def live_projection(contracts: DataFrame, events: DataFrame, entities: DataFrame, versions: DataFrame, registry: DataFrame,
                    stored: DataFrame, cutoff: Column, now: Column) -> LiveRun:
    """Project every (entity, event, stat) a resolved contract asks about.

    Events the cutoff has reached are skipped and recorded as such; re-running
    the same cutoff inserts nothing. ``entities``: entity_id, position.
    """
    wanted = MK.live_candidates(contracts, events, now).withColumnRenamed("stat_type", "measure")
    games = events.select("event_id", "season", F.col("kickoff_at").alias("valid_at"))
    asked = wanted.join(games, "event_id").join(entities, "entity_id", "left").withColumn("cutoff", cutoff).withColumn(
        "target_id", F.concat_ws(":", "entity_id", "event_id", "measure")
    )
    skipped = asked.where(F.col("cutoff") >= F.col("valid_at"))
    timely = asked.where(F.col("cutoff") < F.col("valid_at"))
    requests = materialize(P.prior_requests(timely), "prior-requests")
    priors = materialize(P.walk_forward_priors(versions, requests), "priors")
    found = H.with_history(timely, versions, bucket_seconds=H.stream_width(timely, versions)).drop("window")
    projected = PJ.project(found, priors, registry).withColumn("computed_at", now)
    reason = F.when(F.col("sample_games").isNull(), K.REASON_NO_PRIOR).when(F.col("n_eff") < K.MIN_ELIGIBLE_GAMES, K.REASON_INSUFFICIENT_HISTORY)
    judged = projected.withColumn("reason", reason)
    fresh, drivers = MG.projection_insert(stored, judged.where(F.col("reason").isNull()))
    done = judged.groupBy("event_id").agg(F.count_if(F.col("reason").isNull()).alias("projected_count")).withColumn("status", F.lit("succeeded"))
    late = skipped.select("event_id").distinct().select("event_id", F.lit(0).cast("long").alias("projected_count"), F.lit("skipped").alias("status"))
    return LiveRun(fresh, drivers, done.unionByName(late), judged.where(F.col("reason").isNotNull()).select("target_id", "event_id", "entity_id", "measure", "reason"))


def gameday(events: DataFrame, now: Column, ingest, recompute, minutes: int = K.GAMEDAY_WINDOW_MINUTES):
    """Refresh then recompute the events entering their window.

    ``ingest(window)`` runs first and ``recompute(window)`` reads its cutoff from
    the clock afterwards. With no event in the window neither is called and
    nothing is recorded.
    """
    window = R.window_events(events, now, minutes)
    if window.isEmpty():
        return None
    ingest(window)
    return recompute(window)
