"""Observation streams: unpivot, mapping, as-of reads, counted skips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline import constants as K
from cutline.functions import numbers as N
from cutline.functions import times
from cutline.operators import timeline as TL


def crosswalk(players: DataFrame, external: str, internal: str) -> DataFrame:
    """External id to entity id, incomplete pairs dropped."""
    return players.where(F.col(external).isNotNull() & F.col(internal).isNotNull() & (F.col(external) != "") & (F.col(internal) != "")).select(
        F.col(external), F.col(internal).alias("entity_key")
    ).groupBy(external).agg(F.min("entity_key").alias("entity_key"))


def events_by_side(events: DataFrame) -> DataFrame:
    """One row per (season, week, team) side of each event."""
    return events.select(
        "season", "week", F.explode(F.array("home_team", "away_team")).alias("team"), "event_id", "kickoff_at"
    )


def with_known_parents(rows: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """Rows tagged with ``skip_reason``: NULL loads, anything else is counted."""
    e = entities.select("entity_id").distinct().withColumn("__e", F.lit(True))
    v = events.select("event_id").distinct().withColumn("__v", F.lit(True))
    tagged = rows.join(e, "entity_id", "left").join(v, "event_id", "left")
    reason = (
        F.when(F.col("entity_id").isNull(), "missing_entity")
        .when(F.col("__v").isNull(), "unknown_event")
        .when(F.col("__e").isNull(), "unknown_entity")
    )
    return tagged.withColumn("skip_reason", reason).drop("__e", "__v")


def skip_report(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy(F.coalesce("skip_reason", F.lit("loaded")).alias("outcome")).agg(F.count("*").alias("rows"))


def unpivot(df: DataFrame, ids: list[str], measures: tuple[tuple[str, str, int], ...]) -> DataFrame:
    """Measure columns to (context_type, numeric_value) rows; NULLs make no row.

    Each measure is (context type, column, decimal places).
    """
    typed = df.select(*ids, *[N.fixed_decimal(F.col(c), p, 10).cast("decimal(10,3)").alias(f"__{i}") for i, (_, c, p) in enumerate(measures)])
    pairs = ", ".join(f"'{name}', `__{i}`" for i, (name, _, _) in enumerate(measures))
    tall = typed.select(*ids, F.expr(f"stack({len(measures)}, {pairs}) as (context_type, numeric_value)"))
    return tall.where(F.col("numeric_value").isNotNull())


def snap_observations(snaps: DataFrame) -> DataFrame:
    """``snaps``: entity_id, event_id, team, kickoff_at and the snap columns."""
    tall = unpivot(snaps, ["entity_id", "event_id", "team", "kickoff_at"], K.SNAP_MEASURES)
    return tall.select(
        "entity_id", "event_id", "team", "context_type", "numeric_value", F.lit(None).cast("string").alias("text_value"),
        F.col("kickoff_at").alias("valid_at"), times.published_at(F.col("kickoff_at")).alias("known_at"),
        F.lit(True).alias("known_at_reconstructed"),
    )


def injury_observations(injuries: DataFrame) -> DataFrame:
    """``injuries``: entity_id, event_id, team, report_status, practice_status,
    date_modified (text with a zone). Rows whose instant has no zone are left
    out here and counted by :func:`zoneless_rows`."""
    known = times.observed_to_utc(F.col("date_modified"))
    tall = injuries.withColumn("known_at", known).where(F.col("known_at").isNotNull()).select(
        "entity_id", "event_id", "team", "known_at",
        F.expr("stack(2, 'injury_designation', report_status, 'practice_status', practice_status) as (context_type, text_value)"),
    )
    return tall.where(F.col("text_value").isNotNull() & (F.col("text_value") != "")).select(
        "entity_id", "event_id", "team", "context_type", F.lit(None).cast("decimal(10,3)").alias("numeric_value"), "text_value",
        F.col("known_at").alias("valid_at"), "known_at", F.lit(False).alias("known_at_reconstructed"),
    )


class SchemaDrift(ValueError):
    """A source arrived structurally incomplete."""


def zoneless_rows(injuries: DataFrame) -> int:
    bad = F.col("date_modified").isNotNull() & times.observed_to_utc(F.col("date_modified")).isNull()
    return injuries.where(bad).count()


def require_zoned(injuries: DataFrame) -> None:
    bad = zoneless_rows(injuries)
    if bad:
        raise SchemaDrift(f"{bad} observation(s) arrived without a timezone; refusing to guess their availability")


def observations_as_of(observations: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """All observations of each target's key known by its cutoff.

    ``targets`` holds at most one row per key, so rows never multiply.
    """
    asked = targets.select(*keys, "cutoff")
    return observations.join(asked, keys).where(F.col("known_at") <= F.col("cutoff"))


def latest_observation(
    targets: DataFrame, observations: DataFrame, keys: list[str], value: str, *, order: list[str] | None = None,
    bucket_seconds: int = TL.DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """Targets with the value most recently known at their cutoff."""
    right = observations.select(*keys, "known_at", value, *(order or [])).withColumn("value_known_at", F.col("known_at"))
    return TL.asof_latest(
        targets, right, keys, "cutoff", "known_at", [value, "value_known_at"], right_order=order or [], prefix="latest_",
        bucket_seconds=bucket_seconds,
    )


def weather_rows(events: DataFrame, coords: DataFrame, readings: DataFrame) -> DataFrame:
    """Weather per event: classified, with measures only where observed.

    ``events``: event_id, season, kickoff_at, is_dome, is_neutral_site, home_team.
    ``coords``: team, latitude, longitude.
    ``readings``: event_id, reading_source, temperature_c, wind_kph, precipitation_mm.
    """
    from cutline.functions import rows as RW

    era = times.weather_era(F.col("season"))
    joined = events.join(coords, events.home_team == coords.team, "left").drop("team").join(readings, "event_id", "left")
    status = RW.weather_status(F.col("is_dome"), F.col("is_neutral_site"), F.col("latitude"), F.col("reading_source"))
    out = joined.withColumns({"era": era, "status": status})
    seen = F.col("status") == "observed"
    source = (
        F.when(F.col("status") == "dome", "dome_indoor_venue")
        .when(F.col("is_neutral_site"), "neutral_site_venue_unmapped")
        .when(F.col("status") == "unavailable", "none")
        .when(seen, F.col("reading_source"))
        .otherwise(F.concat(F.lit("source:"), F.col("era")))
    )
    return out.select(
        "event_id", "era", "status", source.alias("weather_source"),
        *[F.when(seen, N.fixed_decimal(F.col(c), 1, 6)).alias(c) for c in ("temperature_c", "wind_kph", "precipitation_mm")],
        F.col("kickoff_at").alias("valid_at"), times.weather_known_at(F.col("kickoff_at"), F.col("era")).alias("known_at"),
    )


def era_label(targets: DataFrame, weather: DataFrame) -> DataFrame:
    """Era from the event's weather row if visible at the cutoff, else the season."""
    w = weather.select("event_id", F.col("era").alias("__era"), F.col("known_at").alias("__known"))
    joined = targets.join(w, "event_id", "left")
    shown = F.when(F.col("__known") <= F.col("cutoff"), F.col("__era"))
    return joined.withColumns({
        "era": F.coalesce(shown, times.weather_era(F.col("season"))),
        "era_source": F.when(shown.isNotNull(), "weather_row").otherwise("season_rule"),
    }).drop("__era", "__known")


def travel(previous: DataFrame, coords: DataFrame, home: Column) -> DataFrame:
    """Rest days and kilometres into the target from its entity's previous venue.

    ``previous`` is the output of ``bitemporal.previous_event``; ``coords`` has
    one row per venue.
    """
    here = coords.select(F.col("team").alias("__here"), F.col("latitude").alias("__lat1"), F.col("longitude").alias("__lon1"))
    there = coords.select(F.col("team").alias("__there"), F.col("latitude").alias("__lat0"), F.col("longitude").alias("__lon0"))
    joined = previous.withColumn("__home", home).join(here, F.col("__home") == F.col("__here"), "left").join(
        there, F.col("prev_venue") == F.col("__there"), "left"
    )
    km = N.haversine_km(F.col("__lat0"), F.col("__lon0"), F.col("__lat1"), F.col("__lon1"))
    return joined.withColumns({
        "rest_days": times.rest_days(F.col("valid_at"), F.col("prev_last_valid_at")),
        "travel_km": km,
    }).drop("__here", "__there", "__lat1", "__lon1", "__lat0", "__lon0", "__home")
