"""Facts with two clocks: what each line said, and over which knowledge interval.

A stat line keeps its current values; a correction keeps the values it replaced.
``value_versions`` turns both into rows carrying a half-open visibility interval
``[visible_from, visible_to)``. Every as-of read is then a comparison of a cutoff
with that interval, so a correction cannot be honoured on one path and missed on
another, and a fact published later cannot be reached.

Lines are long form: entity_id, event_id, measure, season, team, position,
valid_at, published_at, value. Within an entity, published_at must not decrease
as valid_at grows (the publication rule in ``functions.times`` guarantees it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutline.operators import timeline as TL

LINE = ["entity_id", "event_id", "measure"]


def to_long(df: DataFrame, ids: list[str], measures: dict[str, str]) -> DataFrame:
    """Wide measures to one row per measure, NULL kept: absence is a value."""
    pairs = ", ".join(f"'{name}', cast(`{column}` as double)" for name, column in measures.items())
    return df.select(*ids, F.expr(f"stack({len(measures)}, {pairs}) as (measure, value)"))


def corrections_to_long(df: DataFrame, ids: list[str], measures: list[str], snapshot: str = "prior_values") -> DataFrame:
    """One row per correction and measure from a map snapshot.

    ``has_prior`` is false where the snapshot lacks the key: the roll-back then
    keeps the line's own value for that measure.
    """
    named = F.array(*[F.lit(m) for m in measures])
    return df.select(*ids, snapshot, F.explode(named).alias("measure")).select(
        *ids,
        "measure",
        F.map_contains_key(F.col(snapshot), F.col("measure")).alias("has_prior"),
        F.try_element_at(F.col(snapshot), F.col("measure")).alias("prior_value"),
    )


def _whole_line_intervals(corrections: DataFrame) -> DataFrame:
    """One shuffle by line: each correction closes an interval, the last one also opens the current."""
    along, whole = Window.partitionBy(*LINE).orderBy("known_at", "version"), Window.partitionBy(*LINE)
    has, prior = F.col("has_prior"), F.col("prior_value")
    rows = corrections.select(
        *LINE, "known_at", has, prior, F.lag("known_at").over(along).alias("after"), F.lead(F.lit(1)).over(along).isNull().alias("newest"),
        F.max(F.when(has & prior.isNull(), 1).otherwise(0)).over(whole).alias("ever_absent"),
        F.max(F.when(has & prior.isNotNull(), 1).otherwise(0)).over(whole).alias("ever_present"),
    )
    past = F.struct(F.col("after").alias("since"), F.col("known_at").alias("until"), has.alias("has_prior"), prior.alias("prior_value"), F.lit(1).alias("version_seq"))
    current = F.struct(F.col("known_at").alias("since"), F.lit(None).cast("timestamp").alias("until"), F.lit(False).alias("has_prior"),
                       F.lit(None).cast("double").alias("prior_value"), F.lit(0).alias("version_seq"))
    spans = rows.select(*LINE, "ever_absent", "ever_present", F.explode(F.when(F.col("newest"), F.array(past, current)).otherwise(F.array(past))).alias("s"))
    return spans.select(*LINE, "s.*", "ever_absent", "ever_present")


def correction_intervals(corrections: DataFrame, bucket_seconds: int | None = None) -> DataFrame:
    """Knowledge intervals per corrected line: one per correction plus the current one.

    A line's corrections are few; with ``bucket_seconds`` a line of very many is split by time.
    """
    if bucket_seconds is None:
        return _whole_line_intervals(corrections)
    ordered = TL.previous_row(
        corrections, LINE, "known_at", ["version"], ["known_at"], prefix="after_", bucket_seconds=bucket_seconds
    )
    past = ordered.select(
        *LINE,
        F.col("after_known_at").alias("since"),
        F.col("known_at").alias("until"),
        F.col("has_prior"),
        F.col("prior_value"),
        F.lit(1).alias("version_seq"),
    )
    loses = F.when(F.col("has_prior") & F.col("prior_value").isNull(), 1).otherwise(0)
    gains = F.when(F.col("has_prior") & F.col("prior_value").isNotNull(), 1).otherwise(0)
    per_line = corrections.groupBy(*LINE).agg(
        F.max("known_at").alias("since"), F.max(loses).alias("ever_absent"), F.max(gains).alias("ever_present")
    )
    current = per_line.select(
        *LINE,
        "since",
        F.lit(None).cast("timestamp").alias("until"),
        F.lit(False).alias("has_prior"),
        F.lit(None).cast("double").alias("prior_value"),
        F.lit(0).alias("version_seq"),
    )
    flags = per_line.select(*LINE, "ever_absent", "ever_present")
    return past.unionByName(current).join(flags, LINE)


def value_versions(lines: DataFrame, corrections: DataFrame | None) -> DataFrame:
    """Lines with every value they have shown and when it was visible.

    Adds visible_from, visible_to (NULL = still), version_seq (0 = current) and
    ``steady``: the line is present in all its versions, so its presence does
    not depend on the cutoff once published.
    """
    if corrections is None:
        return lines.select(
            *lines.columns,
            F.col("published_at").alias("visible_from"),
            F.lit(None).cast("timestamp").alias("visible_to"),
            F.lit(0).alias("version_seq"),
            F.col("value").isNotNull().alias("steady"),
            F.col("value").isNotNull().alias("ever_present"),
        )
    spans = correction_intervals(corrections)
    joined = lines.join(spans, LINE, "left")
    value = F.when(F.coalesce(F.col("has_prior"), F.lit(False)), F.col("prior_value")).otherwise(F.col("value"))
    keep = [c for c in lines.columns if c != "value"]
    return joined.select(
        *keep,
        value.alias("value"),
        F.greatest("published_at", "since").alias("visible_from"),
        F.col("until").alias("visible_to"),
        F.coalesce("version_seq", F.lit(0)).alias("version_seq"),
        (F.col("value").isNotNull() & (F.coalesce("ever_absent", F.lit(0)) == 0)).alias("steady"),
        (F.col("value").isNotNull() | (F.coalesce("ever_present", F.lit(0)) == 1)).alias("ever_present"),
    ).where(F.col("visible_to").isNull() | (F.col("visible_to") > F.col("visible_from")))


def visible(versions: DataFrame, cutoff: Column) -> DataFrame:
    """The corpus as published at ``cutoff`` (a literal or a column of the frame)."""
    return versions.where(
        (F.col("visible_from") <= cutoff) & (F.col("visible_to").isNull() | (F.col("visible_to") > cutoff))
    )


def presence_changes(versions: DataFrame, amounts: dict[str, Column] | None = None, carry: dict[str, Column] | None = None) -> DataFrame:
    """Versions as dated changes: ``n`` and each amount enter and leave the record.

    Summing the changes up to a cutoff gives the totals as published then.
    ``steady_n`` enters once, at publication. What is in ``carry`` stands on the first
    change of each version and is NULL on its others.
    """
    amounts = amounts or {}
    shown = F.col("value").isNotNull()
    first = (F.col("version_seq") == 0) & F.col("steady")
    merged = first & (F.col("visible_from") == F.col("published_at"))
    zero = {a: (c - c) for a, c in amounts.items()}

    def change(at: Column, n: int, steady: Column, signed: dict[str, Column]) -> Column:
        return F.struct(
            at.alias("at"), F.lit(n).alias("n"), steady.cast("int").alias("steady_n"),
            *[c.alias(a) for a, c in signed.items()],
        )

    enter = F.when(shown, change(F.col("visible_from"), 1, merged, amounts))
    leave = F.when(
        shown & F.col("visible_to").isNotNull(),
        change(F.col("visible_to"), -1, F.lit(False), {a: (zero[a] - c).cast("decimal(38,9)") for a, c in amounts.items()}),
    )
    publish = F.when(first & ~merged, change(F.col("published_at"), 0, F.lit(True), zero))
    if amounts:
        typed = [F.struct(*[e[f].cast("decimal(38,9)").alias(f) if f in amounts else e[f].alias(f)
                            for f in ("at", "n", "steady_n", *amounts)]) for e in (enter, leave, publish)]
        enter, leave, publish = (F.when(e.isNotNull(), t) for e, t in zip((enter, leave, publish), typed))
    rest = [c for c in ("entity_id", "measure", "season") if c in versions.columns]
    carry = carry or {}
    changes = versions.select(*rest, *[c.alias(n) for n, c in carry.items()], F.posexplode(F.array_compact(F.array(enter, leave, publish))).alias("i", "c"))
    return changes.select(*rest, *[F.when(F.col("i") == 0, F.col(n)).alias(n) for n in carry], "c.*")


def event_cutoffs(events: DataFrame, revisions: DataFrame, bucket_seconds: int | None = None) -> DataFrame:
    """Events with ``cutoff``: the kickoff known a week out bounds the actual one.

    An event's revisions are few, so they are read as a whole unless ``bucket_seconds`` is given.

    ``revisions``: event_id, kickoff_at, known_at, revision_seq.
    """
    from cutline import constants as K
    from cutline.functions import times

    week_out = F.col("valid_at") - F.make_dt_interval(F.lit(K.CUTOFF_SCHEDULE_LOOKBACK_DAYS))
    known = TL.asof_latest(
        events.withColumn("__week_out", week_out), revisions, ["event_id"], "__week_out", "known_at", ["kickoff_at"],
        right_order=["revision_seq"], prefix="known_", bucket_seconds=bucket_seconds,
    ).drop("__week_out")
    return known.withColumn("cutoff", times.cutoff(F.col("valid_at"), F.col("known_kickoff_at")))


def previous_event(
    targets: DataFrame, appearances: DataFrame, bucket_seconds: int = TL.DEFAULT_BUCKET_SECONDS
) -> DataFrame:
    """Targets with the entity's latest published earlier event.

    ``appearances``: entity_id, event_id, valid_at, published_at, venue.
    ``targets``: entity_id, event_id, valid_at, cutoff. The last *published*
    appearance is also the last by kickoff, because publication follows kickoff.
    """
    right = appearances.select(
        "entity_id", F.col("event_id").alias("seen_event_id"), F.col("valid_at").alias("seen_valid_at"), "published_at", "venue"
    ).withColumn("last_event_id", F.col("seen_event_id")).withColumn("last_valid_at", F.col("seen_valid_at"))
    # A cutoff never reaches its own event's publication, so the target cannot
    # be its own predecessor while the cutoff precedes kickoff.
    return TL.asof_latest(
        targets, right, ["entity_id"], "cutoff", "published_at", ["last_event_id", "last_valid_at", "venue"],
        right_order=["seen_valid_at", "seen_event_id"], prefix="prev_", bucket_seconds=bucket_seconds,
    )
