"""The stat-type registry. Adding a stat type is one row, never code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cutline import constants as K


@dataclass(frozen=True)
class StatType:
    name: str
    family: str
    thresholds: tuple[float, ...]
    pmf_cap: int | None = None
    floor: float | None = None


def grid(first: float, last: float, step: float) -> tuple[float, ...]:
    return tuple(first + step * i for i in range(round((last - first) / step) + 1))


DEFAULT = tuple(
    StatType(name, family, grid(first, last, step), cap, K.CONTRACT_LIKE_FLOORS.get(name))
    for name, family, first, last, step, cap in K.STAT_TYPES
)

SCHEMA = "measure string, family string, thresholds array<double>, pmf_cap int, floor double, stat_order int"


def registry(spark: SparkSession, stats: tuple[StatType, ...] = DEFAULT) -> DataFrame:
    """One row per stat type: its size is the number of stat types."""
    rows = [(s.name, s.family, list(s.thresholds), s.pmf_cap, s.floor, i) for i, s in enumerate(stats)]
    return spark.createDataFrame(rows, SCHEMA)


def validate(names: list[str], stats: tuple[StatType, ...] = DEFAULT) -> list[str]:
    known = [s.name for s in stats]
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown stat type(s): {', '.join(unknown)}; registered: {', '.join(known)}")
    return names
