"""Prices, slate, snapshots and decisions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline import constants as K
from cutline.functions import distributions as D
from cutline.functions import market as M
from cutline.functions import numbers as N
from cutline.functions import rows as RW
from cutline.functions import times
from cutline.operators import timeline as TL
from cutline.session import cut_lineage, materialize

SIDES = ["yes_bid", "yes_ask", "no_bid", "no_ask"]
STATE = ["is_recommended", "side"]


def latest_prices(book: DataFrame) -> DataFrame:
    return TL.latest_per_key(book, ["contract_id"], ["observed_at", "observation_id"])


def freshest_projections(projections: DataFrame) -> DataFrame:
    """Greatest computed_at per (entity, event, stat), any model version."""
    return TL.latest_per_key(projections, ["entity_id", "event_id", "stat_type"], ["computed_at", "projection_id"])


def with_changes(book: DataFrame, bucket_seconds: int = TL.DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Book rows with ``changed``: first of their contract, or any side moved."""
    seq = TL.previous_row(book, ["contract_id"], "observed_at", ["observation_id"], SIDES, bucket_seconds=bucket_seconds)
    moved = RW.book_differs([F.col(s) for s in SIDES], [F.col(f"prev_{s}") for s in SIDES])
    return seq.select(*book.columns, (~F.col("prev_exists") | moved).alias("changed"))


#: Rows of a run of equal books that are walked in one pass; a longer run is marked by doubling, with the same result.
WALKED_ROWS = 100_000


def _walk(gap_micros: int):
    """Ids of the rows a recorder keeps of each run (a list of times and ids in order): the first, then each first one a gap after the last kept."""

    def run(batches):
        for batch in batches:
            ids = []
            lists = batch.column("rows")
            for i in range(batch.num_rows):
                rows = lists[i].values
                at, names = (rows.field(f).to_numpy() for f in ("at", "id"))
                k, n = 0, len(at)
                while k < n:
                    ids.append(int(names[k]))
                    k = max(k + 1, int(np.searchsorted(at, at[k] + gap_micros)))
            yield pa.record_batch([pa.array(ids, pa.int64())], names=["a"])

    return run


def compact_prices(book: DataFrame, heartbeat_minutes: float = K.PRICE_HEARTBEAT_MINUTES,
                   bucket_seconds: int = TL.DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Rows a change-or-heartbeat recorder would have kept, over a whole history.

    A change is always kept, so each run of equal books stands alone. Inside a
    run the next kept row is the first one a heartbeat or more after the last
    kept, which depends on the one before: a run is walked once, from kept row to kept
    row. A run of over ``WALKED_ROWS`` rows isn't gathered: every row's successor is
    found by an as-of read, and the rows reachable from its start are marked by
    doubling the links, in log2(longest chain) equi-joins on unique ids.
    """
    marked = with_changes(book, bucket_seconds)
    runs = TL.running_totals(
        marked, ["contract_id"], "observed_at", ["observation_id"],
        {"run_no": F.when(F.col("changed"), 1).otherwise(0)}, bucket_seconds=bucket_seconds,
    )
    run = ["contract_id", "run_no"]
    narrow = materialize(runs.select(*run, "observation_id", "observed_at", "changed"), "book-runs")
    long = narrow.groupBy(*run).count().where(F.col("count") > WALKED_ROWS).select(*run)
    any_long = not long.isEmpty()
    if any_long:
        long = materialize(long, "long-runs")
    short = narrow.join(long, run, "left_anti") if any_long else narrow
    gap = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(heartbeat_minutes * 60).cast("decimal(18,6)"))
    lists = short.where("observed_at is not null").groupBy(*run).agg(F.sort_array(F.collect_list(F.struct(F.unix_micros("observed_at").alias("at"), F.col("observation_id").alias("id")))).alias("rows"))
    kept = lists.select("rows").mapInArrow(_walk(round(heartbeat_minutes * 60_000_000)), "a long")
    if any_long:
        kept = kept.unionByName(_doubled(narrow.join(long, run, "left_semi"), gap, bucket_seconds))
    return book.join(kept.select(F.col("a").alias("observation_id")), "observation_id", "left_semi")


def _doubled(narrow: DataFrame, gap: Column, bucket_seconds: int) -> DataFrame:
    """Kept ids (a) of runs of any length."""
    after = narrow.select("contract_id", "run_no", "observation_id", (F.col("observed_at") + gap).alias("due_at"))
    rows = narrow.select("contract_id", "run_no", F.col("observed_at").alias("at"), F.col("observation_id").alias("next_id"))
    succ = TL.asof_next(after, rows, ["contract_id", "run_no"], "due_at", "at", ["next_id"], right_order=["next_id"],
                        inclusive=True, bucket_seconds=bucket_seconds)
    links = cut_lineage(succ.where(F.col("next_id").isNotNull()).select(F.col("observation_id").alias("a"), F.col("next_id").alias("b")))
    kept = cut_lineage(narrow.where("changed").select(F.col("observation_id").alias("a")))
    while not links.isEmpty():
        kept = cut_lineage(kept.unionByName(kept.join(links, "a").select(F.col("b").alias("a"))).distinct())
        onward = links.select(F.col("a").alias("b"), F.col("b").alias("c"))
        links = cut_lineage(links.join(onward, "b").select("a", F.col("c").alias("b")))
    return kept


def transitions(states: DataFrame, prior_snapshots: DataFrame | None = None,
                bucket_seconds: int = TL.DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """States that change the recommendation, with their trigger.

    ``states``: contract_id, at, seq, is_recommended, side. ``prior_snapshots``
    (same columns) are snapshots of any trigger already stored; they count as
    the latest snapshot but are not emitted again.
    """
    base = states.select("contract_id", "at", "seq", *STATE, F.lit(False).alias("stored"))
    if prior_snapshots is not None:
        base = base.unionByName(prior_snapshots.select("contract_id", "at", "seq", *STATE, F.lit(True).alias("stored")))
    seq = TL.previous_row(base, ["contract_id"], "at", ["seq"], STATE, bucket_seconds=bucket_seconds)
    counts = F.when(F.col("stored") | F.col("is_recommended"), 1).otherwise(0)
    seen = TL.running_totals(seq, ["contract_id"], "at", ["seq"], {"snapshots": counts}, bucket_seconds=bucket_seconds)
    earlier = F.col("snapshots") - counts > 0
    rec, prev = F.col("is_recommended"), F.coalesce("prev_is_recommended", F.lit(False))
    trigger = (
        F.when(~earlier & rec, "appeared")
        .when(earlier & (rec != prev), "state_changed")
        .when(earlier & rec & ~F.col("prev_side").eqNullSafe(F.col("side")), "state_changed")
    )
    return seen.withColumn("trigger", trigger).where(F.col("trigger").isNotNull() & ~F.col("stored")).select(
        "contract_id", "at", "seq", *STATE, "trigger"
    )


def latest_fact_per_event(events: DataFrame, game_scoped: list[DataFrame], line_scoped: list[DataFrame], completed: DataFrame) -> DataFrame:
    """Latest known_at per event over its own facts and its teams' finished events.

    ``game_scoped``/``line_scoped``: frames with event_id and known_at. Sharing a
    team is an OR of four equalities; exploding both sides to (season, team) and
    reducing the finished side to its maximum first turns it into one equi-join
    of already aggregated rows.
    """
    def maxima(frames: list[DataFrame]) -> DataFrame:
        parts = [f.groupBy("event_id").agg(F.max("known_at").alias("known_at")) for f in frames]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("event_id").agg(F.max("known_at").alias("known_at"))

    own = events.select("event_id").join(maxima(game_scoped), "event_id", "left")
    sides = lambda df: df.select("event_id", "season", F.explode(F.array_distinct(F.array("home_team", "away_team"))).alias("team"))
    finished = sides(completed).join(maxima(line_scoped), "event_id").groupBy("season", "team").agg(F.max("known_at").alias("known_at"))
    shared = sides(events).join(finished, ["season", "team"]).select("event_id", "known_at")
    return own.unionByName(shared).groupBy("event_id").agg(F.max("known_at").alias("latest_fact_known_at"))


def scored_contracts(contracts: DataFrame, projections: DataFrame, prices: DataFrame,
                     threshold_points: float = K.RECOMMENDATION_THRESHOLD_POINTS) -> DataFrame:
    """Contracts x freshest projection x freshest price; either may be missing."""
    fresh = freshest_projections(projections).select(
        "entity_id", "event_id", "stat_type", "projection_id", "distribution_kind", "params", "confidence",
        "computed_at", "information_cutoff",
    )
    book = latest_prices(prices).select("contract_id", "observation_id", "observed_at", *SIDES)
    joined = contracts.join(fresh, ["entity_id", "event_id", "stat_type"], "left").join(book, "contract_id", "left")
    p = D.at_least(F.col("distribution_kind"), F.col("params"), F.col("threshold"))
    priced = joined.withColumn("model_probability", p)
    return priced.withColumns(M.edge(F.col("model_probability"), F.col("confidence"), F.col("yes_ask"), F.col("no_ask"), threshold_points))


def is_settled(c: str = "resolution_status") -> Column:
    return F.col(c).isin("resolved", "manual_override")


def split_resolved(contracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be priced, and the unresolved ones kept in their own output."""
    whole = F.col("entity_id").isNotNull() & F.col("event_id").isNotNull() & F.col("stat_type").isNotNull() & F.col("threshold").isNotNull()
    active = contracts.where(F.col("status") == "active")
    return active.where(is_settled() & whole), active.where(F.col("resolution_status").isin("unresolved", "ambiguous"))


RANKING = ["adjusted_edge", "edge_points", "kickoff_at", "ticker"]


def rank_slate(df: DataFrame) -> DataFrame:
    """Best adjusted edge first, then raw edge, kickoff, ticker; no edge last."""
    return df.orderBy(F.desc_nulls_last("adjusted_edge"), F.desc_nulls_last("edge_points"), F.asc("kickoff_at"), F.asc("ticker"))


def slate_places(df: DataFrame, unique: list[str]) -> DataFrame:
    """``slate_rank`` of every row in the ranking order, ties broken by ``unique``."""
    far = F.lit(float("inf"))
    keyed = df.withColumns({"__a": F.coalesce(-F.col("adjusted_edge"), far), "__e": F.coalesce(-F.col("edge_points"), far)})
    return TL.global_rank(keyed, ["__a", "__e", *unique], "slate_rank").drop("__a", "__e")


def slate(contracts: DataFrame, events: DataFrame, projections: DataFrame, prices: DataFrame, latest_facts: DataFrame,
          now: Column, *, decisions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ranked rows, unresolved rows). Below-threshold rows stay.

    ``decisions`` is passed for the admin view only and is attached after
    scoring, so a viewer's rows cannot depend on it.
    """
    upcoming = events.where((F.col("status") == "scheduled") & (F.col("kickoff_at") > now)).select(
        "event_id", "kickoff_at", F.concat_ws(" @ ", "away_team", "home_team").alias("game_label")
    )
    resolved, unresolved = split_resolved(contracts)
    scored = scored_contracts(resolved, projections, prices).join(upcoming, "event_id").join(latest_facts, "event_id", "left")
    stale = M.staleness(F.col("kickoff_at"), F.col("information_cutoff"), F.col("latest_fact_known_at"), now)
    rows = scored.withColumns({
        **stale,
        "projection_age": times.age_label(F.col("computed_at"), now),
        "price_age": times.age_label(F.col("observed_at"), now),
    })
    if decisions is not None:
        last = TL.latest_per_key(decisions, ["contract_id"], ["decided_at", "decision_id"]).select("contract_id", "disposition", "decided_at")
        rows = rows.join(last, "contract_id", "left")
    open_events = unresolved.join(upcoming.select("event_id", F.lit(True).alias("__open")), "event_id", "left").where(
        F.col("event_id").isNull() | F.col("__open")
    ).drop("__open")
    book = latest_prices(prices).select("contract_id", "yes_ask", "observed_at")
    return rank_slate(rows), open_events.join(book, "contract_id", "left")


def contract_detail(rows: DataFrame, projections: DataFrame, drivers: DataFrame, contract_id) -> tuple[DataFrame, DataFrame]:
    """One slate row with its projection's quantiles, interval and mid price, and
    that projection's drivers in rank order."""
    row = rows.where(F.col("contract_id") == contract_id)
    extra = projections.select("projection_id", "quantiles", "projected_value", "projected_median", "interval_low", "interval_high", "n_eff")
    detail = row.join(extra, "projection_id", "left").withColumn("yes_mid", N.mid_price(F.col("yes_bid"), F.col("yes_ask")))
    told = drivers.join(row.select("projection_id"), "projection_id", "left_semi").orderBy("rank")
    return detail, told


def final_snapshots(contracts: DataFrame, events: DataFrame, stored: DataFrame, projections: DataFrame, prices: DataFrame,
                    now: Column, minutes: int = K.FINAL_SNAPSHOT_WINDOW_MINUTES) -> DataFrame:
    """One frozen row per resolved contract inside the final window, once ever."""
    inside = events.where(
        (F.col("status") == "scheduled") & times.kicks_off_within(F.col("kickoff_at"), now, minutes=minutes)
    ).select("event_id")
    resolved, _ = split_resolved(contracts)
    done = stored.where(F.col("trigger") == "final_pre_kickoff").select("contract_id")
    due = resolved.join(inside, "event_id", "left_semi").join(done, "contract_id", "left_anti")
    return scored_contracts(due, projections, prices).select(
        "contract_id", "projection_id", "observation_id", "side", "model_probability", "ask_cents", "edge_points", "adjusted_edge",
        "confidence", "is_recommended", F.lit(K.RECOMMENDATION_THRESHOLD_POINTS).alias("threshold_points"),
        F.lit("final_pre_kickoff").alias("trigger"),
    )


def supersede(decisions: DataFrame, bucket_seconds: int | None = TL.DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Recorded decisions: repeats of the current disposition write nothing, and
    each recorded row links the one it replaces."""
    seq = TL.previous_row(decisions, ["contract_id"], "decided_at", ["decision_id"], ["disposition"], bucket_seconds=bucket_seconds)
    new = seq.where(~F.col("prev_exists") | ~F.col("prev_disposition").eqNullSafe(F.col("disposition"))).drop("prev_exists", "prev_disposition")
    linked = TL.previous_row(new, ["contract_id"], "decided_at", ["decision_id"], ["decision_id"], bucket_seconds=bucket_seconds)
    return linked.drop("prev_exists").withColumnRenamed("prev_decision_id", "supersedes_decision_id")


def record_decisions(requests: DataFrame, contracts: DataFrame, events: DataFrame, stored: DataFrame,
                     projections: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions to append with frozen inputs, refused requests).

    ``requests``: decision_id, contract_id, disposition, decided_at. Closed once
    the event has started or is not scheduled; with no event, once the market is
    inactive or past its close time.
    """
    games = events.select("event_id", "kickoff_at", F.col("status").alias("event_status"))
    scored = scored_contracts(contracts, projections, prices).join(games, "event_id", "left")
    asked = requests.join(scored, "contract_id", "left")
    started = (F.col("kickoff_at") <= F.col("decided_at")) | (F.col("event_status") != "scheduled")
    ended = (F.col("status") != "active") | F.coalesce(F.col("close_time") <= F.col("decided_at"), F.lit(False))
    reason = (
        F.when(F.col("ticker").isNull(), "no_such_contract")
        .when(F.col("kickoff_at").isNotNull() & started, "closed")
        .when(F.col("kickoff_at").isNull() & ended, "closed")
    )
    judged = asked.withColumn("refusal", reason)
    ids = ["decision_id", "contract_id", "disposition", "decided_at"]
    open_ = judged.where(F.col("refusal").isNull())
    chain = supersede(stored.select(*ids).unionByName(open_.select(*ids)))
    fresh = chain.join(stored.select("decision_id"), "decision_id", "left_anti").select("decision_id", "supersedes_decision_id")
    frozen = open_.join(fresh, "decision_id").select(
        *ids, "supersedes_decision_id", "projection_id", "observation_id", "model_probability", "side", "ask_cents", "edge_points",
        "confidence", "is_recommended", "computed_at", "information_cutoff", "observed_at",
    )
    return frozen, judged.where(F.col("refusal").isNotNull()).select(*ids, "refusal")


FROZEN = ["projection_id", "observation_id", "model_probability", "side", "ask_cents", "edge_points", "adjusted_edge", "confidence",
          "is_recommended", "computed_at", "information_cutoff", "observed_at"]


def decision_log(requests: DataFrame, contracts: DataFrame, events: DataFrame, stored: DataFrame, projections: DataFrame, prices: DataFrame,
                 bucket_seconds: int | None = None) -> DataFrame:
    """Every request with its ``outcome``; recorded ones freeze what was known at their own instant.

    ``requests`` and ``stored``: decision_id, contract_id, disposition, decided_at. Outcomes: recorded,
    unchanged (the disposition already stands), no_such_contract, event_closed (it has started or isn't scheduled),
    market_closed (no event, and the market is inactive or past its close). The
    projection and the price are those known at ``decided_at``, by as-of reads, so a
    log written late or in one batch holds what a log written at once would have held.
    A recorded row names the decision it replaces; stored rows take part in that and aren't returned.
    Without ``bucket_seconds`` the timelines are split by time only where a contract or subject has many rows.
    """
    width = bucket_seconds or TL.suggest_width([(requests, "decided_at"), (stored, "decided_at"), (prices, "observed_at")], ["contract_id"])
    games = events.select("event_id", "kickoff_at", F.col("status").alias("__event_status"))
    asked = requests.join(contracts.select("contract_id", "entity_id", "event_id", "stat_type", "threshold", F.col("status").alias("__status"), "close_time"), "contract_id", "left").join(games, "event_id", "left")
    started = (F.col("kickoff_at") <= F.col("decided_at")) | (F.col("__event_status") != "scheduled")
    ended = (F.col("__status") != "active") | F.coalesce(F.col("close_time") <= F.col("decided_at"), F.lit(False))
    refusal = (
        F.when(F.col("__status").isNull(), "no_such_contract")
        .when(F.col("kickoff_at").isNotNull() & started, "event_closed")
        .when(F.col("kickoff_at").isNull() & ended, "market_closed")
    )
    judged = materialize(asked.withColumn("refusal", refusal).drop("__status", "__event_status", "close_time", "kickoff_at"), "judged")
    ids = ["decision_id", "contract_id", "disposition", "decided_at"]
    open_ = judged.where("refusal is null")
    chain = supersede(stored.select(*ids).unionByName(open_.select(*ids)), width)
    fresh = chain.join(stored.select("decision_id"), "decision_id", "left_anti").select("decision_id", "supersedes_decision_id")
    taken = materialize(open_.join(fresh, "decision_id"), "taken")
    book = TL.asof_latest(taken.select("decision_id", "contract_id", "decided_at"), prices, ["contract_id"], "decided_at", "observed_at",
                          ["observation_id", "observed_at", *SIDES], right_order=["observation_id"], bucket_seconds=width)
    subject = ["entity_id", "event_id", "stat_type"]
    width = bucket_seconds or TL.suggest_width([(taken, "decided_at"), (projections, "computed_at")], subject)
    known = ["projection_id", "distribution_kind", "params", "confidence", "computed_at", "information_cutoff"]
    model = TL.asof_latest(taken.select("decision_id", *subject, "decided_at"), projections, subject, "decided_at", "computed_at", known,
                           right_order=["projection_id"], bucket_seconds=width)
    seen = taken.join(book.select("decision_id", "observation_id", "observed_at", *SIDES), "decision_id").join(model.select("decision_id", *known), "decision_id")
    seen = seen.withColumn("model_probability", D.at_least(F.col("distribution_kind"), F.col("params"), F.col("threshold")))
    frozen = seen.withColumns(M.edge(F.col("model_probability"), F.col("confidence"), F.col("yes_ask"), F.col("no_ask")))
    frozen = frozen.select(*ids, "supersedes_decision_id", *FROZEN).withColumn("outcome", F.lit("recorded"))
    others = judged.join(frozen.select("decision_id"), "decision_id", "left_anti").select(*ids, F.coalesce("refusal", F.lit("unchanged")).alias("outcome"))
    return frozen.unionByName(others, allowMissingColumns=True)


def live_candidates(contracts: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Distinct (entity, event, stat) of resolved contracts on future events. No
    price column is read."""
    future = events.where((F.col("status") == "scheduled") & (F.col("kickoff_at") > now)).select("event_id")
    whole = F.col("entity_id").isNotNull() & F.col("event_id").isNotNull() & F.col("stat_type").isNotNull()
    return contracts.where(is_settled() & whole).join(future, "event_id", "left_semi").select("entity_id", "event_id", "stat_type").distinct()
