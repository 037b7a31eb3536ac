"""Row-level status, flag and participation rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutline import constants as K
from cutline.functions import numbers as N


def opportunity(count: Column) -> Column:
    number = count.cast("double")
    return F.coalesce((number > 0) & ~F.isnan(number), F.lit(False))


def participation(attempts: Column, carries: Column, targets: Column, position: Column) -> dict[str, Column]:
    """Which phases were played: by opportunity, or by role plus another phase."""
    threw, ran, targeted = opportunity(attempts), opportunity(carries), opportunity(targets)
    role = F.coalesce(position, F.lit(""))
    return {
        "passing": threw,
        "rushing": ran | (role.isin(*K.RUSHING_ROLES) & targeted),
        "receiving": targeted | (role.isin(*K.RECEIVING_ROLES) & ran),
    }


def stat_line_values(position: Column) -> dict[str, Column]:
    """Typed stat columns from source columns; an unplayed phase is NULL, not 0."""
    played = participation(F.col("attempts"), F.col("carries"), F.col("targets"), position)
    phase_of = {c: phase for phase, cols in K.PHASE_COLUMNS.items() for c in cols}
    out = {}
    for column, source, kind in K.STAT_COLUMN_SOURCES:
        typed = N.fixed_decimal(F.col(source), 1, 6) if kind == "decimal" else N.whole(F.col(source))
        out[column] = F.when(played[phase_of[column]], typed)
    return out


def season_type(game_type: Column) -> Column:
    return F.when(game_type == "REG", "REG").when(game_type == "PRE", "PRE").otherwise("POST")


def lenient_date(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def schedule_flags(roof: Column, location: Column, result: Column) -> dict[str, Column]:
    return {
        "is_dome": F.coalesce(roof.isin("dome", "closed"), F.lit(False)),
        "is_neutral_site": F.coalesce(location == "Neutral", F.lit(False)),
        "status": F.when(result.isNotNull(), "completed").otherwise("scheduled"),
    }


def weather_status(is_dome: Column, is_neutral: Column, latitude: Column, reading_source: Column) -> Column:
    return (
        F.when(is_dome, "dome")
        .when(is_neutral | latitude.isNull(), "unavailable")
        .when(reading_source.isNotNull(), "observed")
        .otherwise("request_failed")
    )


def hourly_reading(hours: Column, values: Column, kickoff: Column) -> Column:
    """The value at kickoff's hour from a parallel (hours, values) array pair."""
    wanted = F.date_format(kickoff, "yyyy-MM-dd'T'HH:00")
    at = F.array_position(hours, wanted).cast("int")
    return F.when(at > 0, F.try_element_at(values, F.when(at > 0, at)))


def sync_status(failures: Column, discovered: Column, upserted: Column) -> Column:
    return (
        F.when((failures > 0) & (discovered == 0) & (upserted == 0), "failed")
        .when(failures > 0, "partial")
        .when(discovered == 0, "empty")
        .otherwise("complete")
    )


def attempt_status(sync: Column, finished_at: Column) -> Column:
    """A market sync read as a run attempt: a partial sync is a failure."""
    return (
        F.when(finished_at.isNull(), "running")
        .when(sync.isin("complete", "empty"), "succeeded")
        .otherwise("failed")
    )


def book_differs(left: list[Column], right: list[Column]) -> Column:
    changed = F.lit(False)
    for a, b in zip(left, right):
        changed = changed | ~a.eqNullSafe(b)
    return changed
