"""The ingest cycle: ordered sources, each recorded, required ones decisive."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from cutline import constants as K
from cutline.operators import runs as R
from pyspark.sql import functions as F

RUN_SCHEMA = "dataset string, status string, required boolean, error_message string"


@dataclass(frozen=True)
class Cycle:
    status: str
    sources: DataFrame | None
    error_message: str | None = None


def run_cycle(spark: SparkSession, events: DataFrame, jobs: dict[str, Callable[[int, int], str]], now: dt.datetime, *,
              invocation_id: str, run_log: DataFrame, required: tuple[str, ...] = K.REQUIRED_SOURCES,
              optional: tuple[str, ...] = K.OPTIONAL_SOURCES, category: str = "ingest") -> Cycle:
    """Run each source's job over the upcoming seasons.

    ``jobs[name](season_from, season_to)`` runs one source's Spark job and
    returns its status. One failure does not hide the others; a required one
    fails the cycle. Out of season, or for an invocation already logged, nothing
    runs and nothing is recorded.
    """
    window = R.upcoming_season_window(events, F.lit(now)).first()
    if window["season_from"] is None:
        return Cycle("not_expected", None)
    repeated = run_log.where((F.col("category") == category) & (F.col("invocation_id") == invocation_id))
    if not repeated.isEmpty():
        return Cycle("duplicate", None)
    rows, failed = [], []
    for name in (*required, *optional):
        job = jobs.get(name)
        error = None
        try:
            status = "failed" if job is None else job(window["season_from"], window["season_to"])
            error = "source is not registered" if job is None else None
        except Exception as exc:  # recorded per source; the cycle goes on
            status, error = "failed", f"{type(exc).__name__}: {exc}"
        if status == "failed" and name in required:
            failed.append(name)
        rows.append((name, status, name in required, error))
    sources = spark.createDataFrame(rows, RUN_SCHEMA)
    message = f"required source(s) failed: {', '.join(sorted(failed))}" if failed else None
    return Cycle("failed" if failed else "succeeded", sources, message)
