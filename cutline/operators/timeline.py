"""Ordered reads along a key's timeline that no single hot key can stall.

Every operator here splits a key's rows into time buckets, works inside each
(key, bucket) and passes a one-row summary per bucket forward. A window over a
whole key would put that key's rows in one task; here the widest task holds one
bucket of one key, and the only window over a bare key runs over its bucket
summaries, whose number is the time range divided by the bucket width.

Inputs are read twice, once for the rows and once for the summaries, so callers
pass narrow frames (keys, clock, payload) and join wide attributes back by id.

``bucket_seconds=None`` leaves a key's timeline whole: one shuffle by the key and no
summaries. It is for keys that hold few rows by their nature, or by count (``suggest_width``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutline.session import materialize

DEFAULT_BUCKET_SECONDS = 30 * 86400
#: Rows of a key up to which its timeline is left whole, and slots in which keys are counted.
WHOLE_ROWS = 100_000
COUNT_SLOTS = 65_536


def bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / seconds).cast("long")


def suggest_width(frames: list[tuple[DataFrame, str]], keys: list[str], max_rows: int = WHOLE_ROWS) -> int | None:
    """None if no key has over ``max_rows`` rows in all ``frames`` (each with its clock), else a bucket width.

    Rows are counted by a hash of the key, so what is shuffled doesn't grow with the keys. Keys that share
    a slot count as one, which can only make buckets where none are needed.
    """
    slots = None
    for df, _ in frames:
        one = df.select(F.pmod(F.xxhash64(*keys), F.lit(COUNT_SLOTS)).cast("int").alias("slot"))
        slots = one if slots is None else slots.unionByName(one)
    fullest = slots.groupBy("slot").count().agg(F.max("count")).first()[0]
    if (fullest or 0) <= max_rows:
        return None
    return min(suggest_bucket_seconds(df, keys, ts) for df, ts in frames)


def suggest_bucket_seconds(df: DataFrame, keys: list[str], ts: str, max_rows: int = 2_000_000) -> int:
    """Bucket width that keeps the hottest key near ``max_rows`` rows a bucket.

    One pre-aggregated count; only the single hottest key reaches the driver.
    """
    sizes = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.max(F.unix_seconds(ts)) - F.min(F.unix_seconds(ts))).alias("span"),
    )
    row = sizes.agg(F.max_by("span", "n").alias("span"), F.max("n").alias("n")).first()
    if row is None or not row["n"] or not row["span"]:
        return DEFAULT_BUCKET_SECONDS
    return max(1, min(DEFAULT_BUCKET_SECONDS, int(row["span"] * max_rows / row["n"])))


def _tagged(df: DataFrame, keys: list[str], ts: str, side: int, left: Column, right: Column, order: list[Column]) -> DataFrame:
    return df.select(
        *keys,
        F.col(ts).alias("__ts"),
        F.lit(side).alias("__side"),
        left.alias("__left"),
        right.alias("__right"),
        F.struct(*order).alias("__order") if order else F.struct(F.lit(0)).alias("__order"),
    )


def _null_like(df: DataFrame, column: Column) -> Column:
    return F.lit(None).cast(df.select(column).schema[0].dataType)


def _merged(left, right, keys, left_ts, right_ts, payload, right_order, right_first, seconds):
    left_cols = F.struct(*[F.col(c) for c in left.columns])
    right_cols = F.struct(*[F.col(c) for c in payload])
    order = [F.col(c) for c in right_order]
    lsides = _tagged(left, keys, left_ts, 1 if right_first else 0, left_cols, _null_like(right, right_cols), [])
    order_type = right.select(F.struct(*order)).schema[0].dataType if order else T.StructType([T.StructField("c0", T.IntegerType())])
    lsides = lsides.withColumn("__order", F.lit(None).cast(order_type))
    rsides = _tagged(
        right.where(F.col(right_ts).isNotNull()), keys, right_ts, 0 if right_first else 1,
        _null_like(left, left_cols), right_cols, order,
    )
    if not order:
        rsides = rsides.withColumn("__order", F.struct(F.lit(0).alias("c0")).cast(order_type))
    both = lsides.union(rsides)
    return both if seconds is None else both.withColumn("__bucket", bucket(F.col("__ts"), seconds))


def _part(keys: list[str], seconds: int | None) -> list[str]:
    return [*keys] if seconds is None else [*keys, "__bucket"]


def asof_latest(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    payload: list[str],
    *,
    right_order: list[str] | None = None,
    inclusive: bool = True,
    prefix: str = "",
    bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """Left rows with the latest right row at or before ``left_ts`` (NULL if none).

    ``inclusive=False`` reads strictly earlier rows. Right rows sharing an
    instant are ordered by ``right_order`` and the last one wins.
    """
    both = _merged(left, right, keys, left_ts, right_ts, payload, right_order or [], inclusive, bucket_seconds)
    part = _part(keys, bucket_seconds)
    inside = Window.partitionBy(*part).orderBy("__ts", "__side", "__order").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("__seen", F.last("__right", ignorenulls=True).over(inside)).where(F.col("__left").isNotNull())
    if bucket_seconds is None:
        return rows.select("__left.*", *[F.col("__seen")[c].alias(f"{prefix}{c}") for c in payload])

    ends = both.groupBy(*part).agg(
        F.max_by("__right", F.when(F.col("__right").isNotNull(), F.struct("__ts", "__order"))).alias("__end")
    )
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*part, F.last("__end", ignorenulls=True).over(before).alias("__carry"))
    joined = rows.drop("__right", "__order", "__side", "__ts").join(carry, part, "left")
    found = F.coalesce(F.col("__seen"), F.col("__carry"))
    return joined.select(
        "__left.*", *[found[c].alias(f"{prefix}{c}") for c in payload]
    )


def asof_next(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    payload: list[str],
    *,
    right_order: list[str] | None = None,
    inclusive: bool = False,
    prefix: str = "",
    bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """Left rows with the earliest right row after ``left_ts`` (at it, if inclusive).

    Right rows sharing an instant are ordered by ``right_order``; the first wins.
    """
    both = _merged(left, right, keys, left_ts, right_ts, payload, right_order or [], not inclusive, bucket_seconds)
    part = _part(keys, bucket_seconds)
    # Scanning backwards keeps the running value incremental.
    backwards = Window.partitionBy(*part).orderBy(
        F.col("__ts").desc(), F.col("__side").desc(), F.col("__order").desc()
    ).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("__seen", F.last("__right", ignorenulls=True).over(backwards)).where(F.col("__left").isNotNull())
    if bucket_seconds is None:
        return rows.select("__left.*", *[F.col("__seen")[c].alias(f"{prefix}{c}") for c in payload])
    starts = both.groupBy(*part).agg(
        F.min_by("__right", F.when(F.col("__right").isNotNull(), F.struct("__ts", "__order"))).alias("__start")
    )
    after = Window.partitionBy(*keys).orderBy(F.col("__bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = starts.select(*part, F.last("__start", ignorenulls=True).over(after).alias("__carry"))
    joined = rows.drop("__right", "__order", "__side", "__ts").join(carry, part, "left")
    found = F.coalesce(F.col("__seen"), F.col("__carry"))
    return joined.select("__left.*", *[found[c].alias(f"{prefix}{c}") for c in payload])


def asof_totals(
    left: DataFrame,
    changes: DataFrame,
    keys: list[str],
    left_ts: str,
    change_ts: str,
    amounts: list[str],
    *,
    inclusive: bool = True,
    bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """Left rows with each amount summed over the changes up to ``left_ts``.

    Use integer or decimal amounts: their sums do not depend on row order.
    """
    both = _merged(left, changes, keys, left_ts, change_ts, amounts, [], inclusive, bucket_seconds)
    part = _part(keys, bucket_seconds)
    inside = Window.partitionBy(*part).orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    running = both.select(
        *part, "__left",
        *[F.sum(F.col("__right")[a]).over(inside).alias(f"__in_{a}") for a in amounts],
    ).where(F.col("__left").isNotNull())
    if bucket_seconds is None:
        return running.select("__left.*", *[F.coalesce(F.col(f"__in_{a}"), F.lit(0)).alias(a) for a in amounts])
    ends = both.groupBy(*part).agg(*[F.sum(F.col("__right")[a]).alias(f"__sum_{a}") for a in amounts])
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*part, *[F.sum(f"__sum_{a}").over(before).alias(f"__before_{a}") for a in amounts])
    joined = running.join(carry, part, "left")
    total = {
        a: F.coalesce(F.col(f"__in_{a}"), F.lit(0)) + F.coalesce(F.col(f"__before_{a}"), F.lit(0)) for a in amounts
    }
    return joined.select("__left.*", *[c.alias(a) for a, c in total.items()])


def running_totals(
    df: DataFrame,
    keys: list[str],
    ts: str,
    order: list[str],
    amounts: dict[str, Column],
    *,
    bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """``df`` with inclusive running sums per key in (ts, order) sequence."""
    part = _part(keys, bucket_seconds)
    rows = df if bucket_seconds is None else df.withColumn("__bucket", bucket(F.col(ts), bucket_seconds))
    inside = Window.partitionBy(*part).orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumns({f"__in_{a}": F.sum(c).over(inside) for a, c in amounts.items()})
    if bucket_seconds is None:
        return within.select(*df.columns, *[F.coalesce(F.col(f"__in_{a}"), F.lit(0)).alias(a) for a in amounts])
    ends = rows.groupBy(*part).agg(*[F.sum(c).alias(f"__sum_{a}") for a, c in amounts.items()])
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*part, *[F.sum(f"__sum_{a}").over(before).alias(f"__before_{a}") for a in amounts])
    joined = within.join(carry, part, "left")
    totals = [
        (F.coalesce(F.col(f"__in_{a}"), F.lit(0)) + F.coalesce(F.col(f"__before_{a}"), F.lit(0))).alias(a)
        for a in amounts
    ]
    return joined.select(*df.columns, *totals)


def previous_row(
    df: DataFrame,
    keys: list[str],
    ts: str,
    order: list[str],
    payload: list[str],
    *,
    prefix: str = "prev_",
    bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """``df`` with the previous row's payload per key in (ts, order) sequence.

    ``<prefix>exists`` tells a first row from a previous row holding NULLs.
    """
    part = _part(keys, bucket_seconds)
    rows = df if bucket_seconds is None else df.withColumn("__bucket", bucket(F.col(ts), bucket_seconds))
    packed = F.struct(*[F.col(c) for c in payload])
    inside = Window.partitionBy(*part).orderBy(ts, *order)
    within = rows.withColumn("__seen", F.lag(packed).over(inside))
    if bucket_seconds is None:
        return _with_previous(within, df.columns, F.col("__seen"), payload, prefix)
    ends = rows.groupBy(*part).agg(F.max_by(packed, F.struct(ts, *order)).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__bucket")
    carry = ends.select(*part, F.lag("__end").over(before).alias("__carry"))
    return _with_previous(within.join(carry, part, "left"), df.columns, F.coalesce(F.col("__seen"), F.col("__carry")), payload, prefix)


def _with_previous(rows: DataFrame, columns: list[str], found: Column, payload: list[str], prefix: str) -> DataFrame:
    return rows.select(*columns, found.isNotNull().alias(f"{prefix}exists"), *[found[c].alias(f"{prefix}{c}") for c in payload])


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], *, where: Column | None = None) -> DataFrame:
    """The last row of each key by ``order``: a partial aggregate, never a sort
    of a whole key. End ``order`` with a unique column."""
    rows = df.where(where) if where is not None else df
    rest = [c for c in df.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def earliest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, *, salts: int = 32, salt_on: list[str]) -> DataFrame:
    """First ``k`` rows of each key, in two rounds: per (key, salt), then per key.

    The second round sees at most ``k * salts`` rows of a key.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
    first = Window.partitionBy(*keys, "__salt").orderBy(*order)
    kept = salted.withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") <= k).drop("__rn", "__salt")
    final = Window.partitionBy(*keys).orderBy(*order)
    return kept.withColumn("rank_in_key", F.row_number().over(final)).where(F.col("rank_in_key") <= k)


def next_rows(
    targets: DataFrame,
    rows: DataFrame,
    keys: list[str],
    target_ts: str,
    row_ts: str,
    order: list[str],
    limit: Column,
    *,
    bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """Each target with the first ``limit`` rows after its instant, one per line.

    Rows are numbered along their key, the target's position among them is an
    as-of count, and the wanted numbers are joined by equality, so a key's rows
    are never paired with all of its targets. Adds ``nth`` (1 = the next row).
    """
    numbered = running_totals(rows, keys, row_ts, order, {"__no": F.lit(1)}, bucket_seconds=bucket_seconds)
    one = rows.select(*keys, F.col(row_ts).alias("__at"), F.lit(1).alias("__passed"))
    placed = asof_totals(targets, one, keys, target_ts, "__at", ["__passed"], bucket_seconds=bucket_seconds)
    steps = F.when(limit > 0, F.sequence(F.lit(1), limit.cast("int"))).otherwise(F.array().cast("array<int>"))
    wanted = placed.withColumn("nth", F.explode(steps)).withColumn("__no", F.col("__passed") + F.col("nth")).drop("__passed")
    return wanted.join(numbered, [*keys, "__no"]).drop("__no")


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Position of every row in a total order, without one window over them all.

    Rows are range-partitioned on the whole order, so equal leading values are
    split too, and stored with their partition number; each row's place is its
    number inside the partition plus the sizes of the partitions before it.
    Storing fixes the partition numbers, which a recomputation could move.
    """
    stored = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    sizes = stored.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shuffle partition.
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy(*order)
    placed = stored.join(F.broadcast(starts), "__part").withColumn(name, F.row_number().over(inside) + F.col("__start"))
    return placed.drop("__part", "__start")
