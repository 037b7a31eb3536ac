"""Rounding, coercion and book-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline import constants as K


def nan_to_null(value: Column) -> Column:
    number = value.cast("double")
    return F.when(~F.isnan(number), value)


def fixed_decimal(value: Column, places: int = 1, precision: int = 18) -> Column:
    """Half-even fixed scale; NaN and NULL stay absent."""
    wide = nan_to_null(value).cast("string").cast(f"decimal(38,{places + 12})")
    return F.bround(wide, places).cast(f"decimal({precision},{places})")


def whole(value: Column) -> Column:
    """Truncating integer; NaN and NULL stay absent."""
    return nan_to_null(value).cast("long")


def half_even(value: Column, places: int) -> Column:
    """Half-even on the printed decimal form, so binary noise cannot move a tie."""
    printed = value.cast("string").cast(f"decimal(38,{places + 12})")
    # Away from a tie the nearest whole number is the same and needs no text; NaN and large values take the other way.
    scaled = value.cast("double") * F.lit(float(10**places))
    plain = (F.abs(scaled) < 1e9) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-6)
    return F.when(plain, F.rint(scaled) / F.lit(float(10**places)) + 0.0).otherwise(F.bround(printed, places).cast("double"))


def half_up_2(value: Column) -> Column:
    return F.floor(value * 100 + 0.5) / 100


def quantise(df: DataFrame, places: dict[str, int] | None = None) -> DataFrame:
    """Apply the quantisation map to whichever of its columns are present."""
    wanted = places if places is not None else K.QUANTISATION
    present = {c: half_even(F.col(c), p) for c, p in wanted.items() if c in df.columns}
    return df.withColumns(present) if present else df


def book_side(value: Column) -> Column:
    """Integer cents in 1..99. An empty side is absent, not free."""
    number = value.cast("double")
    cents = F.floor(number + 0.5)
    finite = ~F.isnan(number) & (F.abs(number) < 1e15)
    return F.when(finite & cents.between(1, 99), cents.cast("int"))


def mid_price(bid: Column, ask: Column) -> Column:
    return F.floor((bid + ask) / 2 + 0.5).cast("int")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, l1, p2, l2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((l2 - l1) / 2), 2)
    return F.round(F.lit(2 * K.EARTH_RADIUS_KM) * F.asin(F.sqrt(h)), 1)


def contract_like(stat_type: Column, projected: Column, multiple: float = 1.0, floors: dict | None = None) -> Column:
    """Projection clears its stat type's volume floor; no floor means no."""
    table = floors if floors is not None else K.CONTRACT_LIKE_FLOORS
    floor = F.element_at(literal_map(table), stat_type)
    return F.coalesce(projected >= floor * multiple, F.lit(False))


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
