"""Merges as pure functions of (current, incoming).

Parquet has no row-level update, so each merge returns the new current frame,
the rows to append to its log, and its counters; the sink overwrites the touched
partitions and appends the rest. Every merge is one full outer equi-join on a
unique key, and comparisons treat NULL as a value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline import constants as K
from cutline.functions import times
from cutline.operators import timeline as TL


@dataclass(frozen=True)
class Merge:
    current: DataFrame
    log: DataFrame | None
    actions: DataFrame

    def counters(self) -> DataFrame:
        """One row per action with its count."""
        return self.actions.groupBy("action").agg(F.count("*").alias("rows"))


def last_wins(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row with the greatest sequence per key. Rows have no inherent order
    here, so the sequence column is required."""
    return TL.latest_per_key(df, keys, [sequence])


def collapsed_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows :func:`last_wins` folds away."""
    total = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return total.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("collapsed"))


def _sides(current: DataFrame, incoming: DataFrame, keys: list[str], current_cols: list[str], incoming_cols: list[str]) -> DataFrame:
    a = current.select(*keys, F.struct(*current_cols).alias("__cur"))
    b = incoming.select(*keys, F.struct(*incoming_cols).alias("__new"))
    return a.join(b, keys, "full_outer")


def _differs(columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col("__cur")[c].eqNullSafe(F.col("__new")[c])
    return out


def upsert_if_distinct(
    current: DataFrame, incoming: DataFrame, keys: list[str], values: list[str], *,
    compare: list[str] | None = None, protect: Column | None = None,
) -> Merge:
    """Insert new keys, update changed ones, leave equal ones untouched.

    ``compare`` limits which columns trigger an update; ``protect`` is a
    predicate over ``__cur`` fields naming rows that must never be overwritten.
    """
    both = _sides(current, incoming, keys, values, values)
    kept = F.coalesce(protect, F.lit(False)) if protect is not None else F.lit(False)
    action = (
        F.when(F.col("__cur").isNull(), "inserted")
        .when(F.col("__new").isNull(), "kept")
        .when(kept, "protected")
        .when(_differs(compare or values), "updated")
        .otherwise("unchanged")
    )
    staged = both.withColumn("action", action)
    fresh = F.col("action").isin("inserted", "updated")
    merged = staged.select(*keys, *[F.when(fresh, F.col("__new")[v]).otherwise(F.col("__cur")[v]).alias(v) for v in values])
    return Merge(merged, None, staged.select(*keys, "action"))


def correction_merge(
    current: DataFrame, incoming: DataFrame, measures: list[str], known_at: Column, *,
    keys: tuple[str, str] = ("entity_id", "event_id"), sequence: str | None = None,
) -> Merge:
    """Versioned facts: a changed line is logged with both snapshots, its version
    bumped and its known_at moved; an equal line is a no-op.

    ``current``: keys, team, measures, version, valid_at, known_at.
    ``incoming``: keys, team, measures, valid_at (and ``sequence``).
    """
    k = list(keys)
    batch = last_wins(incoming, k, sequence) if sequence else incoming
    both = _sides(current, batch, k, ["team", *measures, "version", "valid_at", "known_at"], ["team", *measures, "valid_at"])
    cur, new = F.col("__cur"), F.col("__new")
    action = (
        F.when(cur.isNull(), "inserted").when(new.isNull(), "kept").when(_differs(measures), "corrected").otherwise("unchanged")
    )
    staged = both.withColumn("action", action)
    act = F.col("action")
    merged = staged.select(
        *k,
        F.when(act == "inserted", new["team"]).otherwise(cur["team"]).alias("team"),
        *[F.when(act.isin("inserted", "corrected"), new[m]).otherwise(cur[m]).alias(m) for m in measures],
        F.when(act == "inserted", 1).when(act == "corrected", cur["version"] + 1).otherwise(cur["version"]).alias("version"),
        F.when(act == "inserted", new["valid_at"]).otherwise(cur["valid_at"]).alias("valid_at"),
        F.when(act == "inserted", times.published_at(new["valid_at"])).when(act == "corrected", known_at).otherwise(cur["known_at"]).alias("known_at"),
    )

    def snapshot(side: Column) -> Column:
        return F.create_map(*[x for m in measures for x in (F.lit(m), side[m].cast("double"))])

    log = staged.where(act == "corrected").select(
        *k, (cur["version"] + 1).alias("version"), snapshot(cur).alias("prior_values"),
        snapshot(new).alias("corrected_values"), known_at.alias("known_at"),
    )
    return Merge(merged, log, staged.select(*k, "action"))


class UnknownTeam(ValueError):
    """A schedule names a team the dimension does not hold."""


def require_known_teams(schedule: DataFrame, teams: DataFrame, code: str = "team_code") -> None:
    found = unknown_teams(schedule, teams, code).agg(F.count("*").alias("n"), F.min(code).alias("first")).first()
    if found.n:
        raise UnknownTeam(f"{found.n} unknown team codes in schedule, first {found['first']}; unknown_teams lists them")


def unknown_teams(schedule: DataFrame, teams: DataFrame, code: str = "team_code") -> DataFrame:
    """Every code that the schedule names and the dimension does not hold."""
    used = schedule.select(F.explode(F.array("home_team", "away_team")).alias(code)).distinct()
    return used.join(teams.select(code), code, "left_anti")


def schedule_merge(current: DataFrame, incoming: DataFrame, revision_known_at: Column) -> Merge:
    """Events plus their revision stream.

    A new event's first revision is what the schedule said when it came out, so
    its status is always 'scheduled' and its known_at the release. A change of
    kickoff, venue or status appends a revision known from now.
    Events without a kickoff are skipped and counted.
    """
    attrs = ["season", "season_type", "home_team", "away_team", "kickoff_at", "venue", "status"]
    dated = incoming.where(F.col("kickoff_at").isNotNull())
    undated = incoming.where(F.col("kickoff_at").isNull()).select("event_id", F.lit("skipped").alias("action"))
    both = _sides(current, dated, ["event_id"], attrs, attrs)
    cur, new, act = F.col("__cur"), F.col("__new"), F.col("action")
    moving = ["kickoff_at", "venue", "status"]
    staged = both.withColumn(
        "action",
        F.when(cur.isNull(), "inserted").when(new.isNull(), "kept").when(_differs(moving), "updated").otherwise("unchanged"),
    )
    merged = staged.select(
        "event_id",
        *[
            (F.when(act.isin("inserted", "updated"), new[a]) if a in moving else F.when(act == "inserted", new[a])).otherwise(cur[a]).alias(a)
            for a in attrs
        ],
    )
    release = times.schedule_release(new["season"], new["season_type"], new["kickoff_at"])
    log = staged.where(act.isin("inserted", "updated")).select(
        "event_id", new["kickoff_at"].alias("kickoff_at"), new["venue"].alias("venue"),
        F.when(act == "inserted", "scheduled").otherwise(new["status"]).alias("status"),
        F.when(act == "inserted", release).otherwise(revision_known_at).alias("known_at"),
        F.lit(True).alias("known_at_reconstructed"),
    )
    return Merge(merged, log, staged.select("event_id", "action").unionByName(undated))


def append_if_new(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> Merge:
    """Rows whose key is neither stored nor repeated within the batch; of repeats the first by ``order``."""
    first = TL.earliest_per_key(incoming, keys, order)
    fresh = first.join(current.select(*keys), keys, "left_anti")
    actions = fresh.select(*keys, F.lit("inserted").alias("action"))
    return Merge(current.unionByName(fresh, allowMissingColumns=True), fresh, actions)


def weather_merge(current: DataFrame, incoming: DataFrame) -> Merge:
    measures = ["status", "temperature_c", "wind_kph", "precipitation_mm"]
    return upsert_if_distinct(
        current, incoming, ["event_id"], [*measures, "era", "weather_source", "valid_at", "known_at"], compare=measures
    )


def projection_insert(stored: DataFrame, computed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New projections by their five-part key, and the drivers of those only."""
    from cutline.functions import keys as KEY

    key = ["entity_id", "event_id", "measure", "model_version", "cutoff"]
    ident = KEY.projection_key(
        F.col("entity_id").cast("string"), F.col("event_id").cast("string"), F.col("measure"), F.col("model_version"), F.col("cutoff")
    )
    fresh = computed.join(stored.select(*key), key, "left_anti").withColumn("projection_id", ident)
    drivers = fresh.select("projection_id", F.posexplode("drivers").alias("rank", "text")).withColumn(
        "driver_id", KEY.driver_key(F.col("projection_id"), F.col("rank"))
    )
    return fresh, drivers


def contract_merge(current: DataFrame, incoming: DataFrame, observed_at: Column) -> Merge:
    """Listings: new tickers enter resolved as parsed, unsettled ones re-resolve,
    settled ones keep their mapping; all are seen and active again."""
    mapping = ["entity_id", "event_id", "stat_type", "threshold", "resolution_status", "resolution_note"]
    cur_cols = [*mapping, "status", "close_time", "first_seen_at", "last_seen_at"]
    both = _sides(current, incoming, ["ticker"], cur_cols, [*mapping, "close_time"])
    cur, new, act = F.col("__cur"), F.col("__new"), F.col("action")
    unsettled = cur["resolution_status"].isin("unresolved", "ambiguous")
    staged = both.withColumn(
        "action",
        F.when(cur.isNull(), "inserted").when(new.isNull(), "absent").when(unsettled, "re_resolved").otherwise("refreshed"),
    )
    merged = staged.select(
        "ticker",
        *[F.when(act.isin("inserted", "re_resolved"), new[m]).otherwise(cur[m]).alias(m) for m in mapping],
        F.when(act == "absent", cur["status"]).otherwise("active").alias("status"),
        F.when(act == "absent", cur["close_time"]).otherwise(new["close_time"]).alias("close_time"),
        F.when(act == "inserted", observed_at).otherwise(cur["first_seen_at"]).alias("first_seen_at"),
        F.when(act == "absent", cur["last_seen_at"]).otherwise(observed_at).alias("last_seen_at"),
    )
    return Merge(merged, None, staged.select("ticker", "action"))


def delist(contracts: DataFrame, seen: DataFrame, sync: DataFrame, series: tuple[str, ...] | None = None) -> DataFrame:
    """Active contracts a complete, non-empty discovery no longer returned.

    ``sync``: one row with failures and discovered. A partial or empty discovery
    delists nothing.
    """
    governed = F.col("series").isin(*series) if series else F.lit(True)
    complete = sync.agg(((F.max("failures") == 0) & (F.max("discovered") > 0)).alias("complete")).scalar()
    absent = contracts.where((F.col("status") == "active") & governed).join(seen.select("ticker").distinct(), "ticker", "left_anti")
    return absent.where(complete).withColumn("status", F.lit("delisted"))


def pipeline_start(log: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested runs not yet recorded under (category, invocation_id)."""
    key = ["category", "invocation_id"]
    first = TL.earliest_per_key(requested, key, ["started_at", "run_id"])
    return first.join(log.select(*key), key, "left_anti").withColumn("status", F.lit("running"))


LOG_STARTED, LOG_FINISHED = "started", "finished"


def fold_runs(log: DataFrame, now: Column, hours: int = K.STALE_RUN_HOURS) -> DataFrame:
    """The state of every logical run, folded from its append-only log in whatever order that came.

    ``log``: run_id, category, invocation_id, kind (started or finished), status, error_message, at, seq.
    The first start of an invocation is its run; later deliveries of the invocation are
    counted and nothing they report is taken. The last terminal entry decides, so a report that
    comes late replaces an earlier one. A run that has none ``hours`` after its start was abandoned:
    that is read off the log and never written, so its own late report still counts.
    Two partial aggregates, by run and by invocation; no run's entries are gathered.
    """
    began, ended = F.col("kind") == LOG_STARTED, F.col("kind") == LOG_FINISHED
    per = log.groupBy("run_id").agg(
        F.min(F.when(began, F.struct("at", "seq", "category", "invocation_id"))).alias("began"),
        F.max(F.when(ended, F.struct("at", "seq", "status", "error_message"))).alias("ended"),
        F.count_if(ended).alias("reports"),
    ).where(F.col("began").isNotNull())
    runs = per.groupBy(F.col("began.category").alias("category"), F.col("began.invocation_id").alias("invocation_id")).agg(
        F.min(F.struct("began.at", "began.seq", "run_id", "ended", "reports")).alias("r"), F.count("*").alias("deliveries")
    )
    started, ended = F.col("r.at"), F.col("r.ended")
    stale = ended.isNull() & (started < now - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return runs.select(
        F.col("r.run_id").alias("run_id"), "category", "invocation_id",
        F.when(ended.isNotNull(), ended["status"]).when(stale, "interrupted").otherwise("running").alias("status"),
        started.alias("started_at"), F.when(stale, now).otherwise(ended["at"]).alias("finished_at"),
        F.when(stale, "abandoned: no report in time").otherwise(ended["error_message"]).alias("error_message"),
        "deliveries", F.greatest(F.col("r.reports") - 1, F.lit(0)).alias("late_reports"),
    )


def ignored_reports(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Terminal entries that no run of :func:`fold_runs` takes: of a repeated delivery, or of a run that never started."""
    return log.where(F.col("kind") == LOG_FINISHED).join(runs.select("run_id"), "run_id", "left_anti")


def event_outcomes(records: DataFrame) -> DataFrame:
    """Latest outcome per (run, event): a retry replaces its own row."""
    return TL.latest_per_key(records, ["run_id", "event_id"], ["finished_at", "status"])


def reap_stale_runs(runs: DataFrame, now: Column, hours: int = K.STALE_RUN_HOURS) -> DataFrame:
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return runs.withColumns({
        "error_message": F.when(stale, F.coalesce("error_message", F.lit("reaped: abandoned run"))).otherwise(F.col("error_message")),
        "finished_at": F.when(stale, F.coalesce("finished_at", now)).otherwise(F.col("finished_at")),
        "status": F.when(stale, "interrupted").otherwise(F.col("status")),
    })

