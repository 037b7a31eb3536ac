"""Clock expressions: zone conversion, publication, release and cutoff rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutline import constants as K


def eastern_to_utc(day: Column, time: Column) -> Column:
    """Eastern wall clock to UTC; a missing time is midnight, a missing day NULL."""
    clock = F.coalesce(F.nullif(time, F.lit("")), F.lit("00:00"))
    local = F.try_to_timestamp(F.concat_ws(" ", F.nullif(day, F.lit("")), clock), F.lit("yyyy-MM-dd HH:mm"))
    return F.when(day.isNotNull(), F.to_utc_timestamp(local, K.EASTERN))


def published_at(valid_at: Column) -> Column:
    """09:00 Eastern on the day after the event's Eastern date, in UTC."""
    next_day = F.date_add(F.to_date(F.from_utc_timestamp(valid_at, K.EASTERN)), 1)
    return F.to_utc_timestamp(next_day.cast("timestamp") + F.expr("INTERVAL 9 HOURS"), K.EASTERN)


def season_release(season: Column) -> Column:
    """Regular schedules are public by noon on 1 August of their season."""
    return F.make_timestamp(season, F.lit(8), F.lit(1), F.lit(12), F.lit(0), F.lit(0))


def postseason_release(kickoff: Column) -> Column:
    return kickoff - F.make_dt_interval(F.lit(K.POSTSEASON_RELEASE_DAYS))


def schedule_release(season: Column, season_type: Column, kickoff: Column) -> Column:
    return F.when(season_type == "POST", postseason_release(kickoff)).otherwise(season_release(season))


def weather_era(season: Column) -> Column:
    return F.when(season >= K.ARCHIVED_FORECAST_FROM_SEASON, "archived_forecast").otherwise("reanalysis")


def weather_known_at(kickoff: Column, era: Column) -> Column:
    lags = K.FORECAST_LAG_HOURS
    hours = F.when(era == "archived_forecast", lags["archived_forecast"]).otherwise(lags["reanalysis"])
    return kickoff - F.make_dt_interval(F.lit(0), hours)


def observed_to_utc(text: Column) -> Column:
    """An observed instant must carry its zone; anything else is NULL.

    The caller counts the NULLs (see ``operators.context``): guessing a zone for
    an observed fact would move the leakage boundary.
    """
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.try_to_timestamp(text))


def cutoff(kickoff: Column, kickoff_a_week_out: Column) -> Column:
    """Earlier of actual and week-out kickoff, less the lead. NULL is ignored."""
    return F.least(kickoff, kickoff_a_week_out) - F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(K.CUTOFF_MINUTES_BEFORE_KICKOFF)
    )


def rest_days(kickoff: Column, previous_kickoff: Column) -> Column:
    return F.datediff(kickoff, previous_kickoff)


def weeks_between(later: Column, earlier: Column) -> Column:
    """Whole elapsed days over seven."""
    return F.floor((F.unix_seconds(later) - F.unix_seconds(earlier)) / 86400) / F.lit(7.0)


def is_returning(kickoff: Column, last_kickoff: Column) -> Column:
    return F.coalesce(weeks_between(kickoff, last_kickoff) >= K.RETURNING_ABSENCE_WEEKS, F.lit(False))


def kicks_off_within(kickoff: Column, now: Column, *, minutes: int) -> Column:
    """Kickoff in (now, now + minutes]."""
    return (kickoff > now) & (kickoff <= now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))


def upcoming_within(kickoff: Column, now: Column, *, hours: int) -> Column:
    """Kickoff in [now, now + hours]: the closed form used for expectations."""
    return (kickoff >= now) & (kickoff <= now + F.make_dt_interval(F.lit(0), F.lit(hours)))


def age_label(since: Column, now: Column) -> Column:
    """``38m``, ``6h``, ``2d 4h``; an instant in the future reads ``0m``."""
    minutes = F.greatest(F.lit(0), F.floor((F.unix_millis(now) - F.unix_millis(since)) / 60000)).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    days = F.floor(hours / 24).cast("long")
    spare = hours - days * 24
    return (
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h")))
        .when(spare > 0, F.concat(days.cast("string"), F.lit("d "), spare.cast("string"), F.lit("h")))
        .when(spare == 0, F.concat(days.cast("string"), F.lit("d")))
    )
