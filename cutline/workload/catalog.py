"""The query catalog: each entry is a Spark callable with its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(check: str | None = None):
    """Register a query under its function name, with the SQL that checks it."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if check is not None:
            CHECKS[fn.__name__] = check
        return fn

    return add


def rnd(column: str | Column, places: int, name: str | None = None) -> Column:
    """Rounded as the checks round it: decimal ties go up, zero has no sign."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.round(c.cast("double") + F.lit(1e-9), places) + F.lit(0.0)
    return out.alias(name or column) if isinstance(column, str) or name else out
