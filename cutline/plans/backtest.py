"""The backtest as one DAG over every candidate at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline import constants as K
from cutline.functions import distributions as D
from cutline.functions import keys
from cutline.functions import numbers as N
from cutline.operators import bitemporal as B
from cutline.operators import context as CX
from cutline.operators import history as H
from cutline.operators import priors as P
from cutline.operators import projection as PJ
from cutline.operators import timeline as TL
from cutline.session import materialize


@dataclass(frozen=True)
class Backtest:
    candidates: DataFrame
    predictions: DataFrame
    exclusions: DataFrame
    thresholds: DataFrame
    priors: DataFrame


def events_in_scope(events: DataFrame, first: int, last: int, season_types: tuple[str, ...] = ("REG",), limit: int | None = None) -> DataFrame:
    """Events of the asked seasons. ``limit`` is the caller's recorded bound on a
    run: the first events by kickoff, ids breaking ties."""
    scope = events.where(F.col("season").between(first, last) & F.col("season_type").isin(*season_types))
    return scope if limit is None else scope.orderBy("valid_at", "event_id").limit(limit)


@dataclass(frozen=True)
class Scope:
    """Which events and measures a run covers, recorded with the run."""

    first: int
    last: int
    measures: tuple[str, ...]
    season_types: tuple[str, ...] = ("REG",)
    limit_events: int | None = None


def targets_from_events(
    events: DataFrame, revisions: DataFrame, versions: DataFrame, entities: DataFrame, weather: DataFrame, scope: Scope,
    *, bucket_seconds: int | None = None,
) -> DataFrame:
    """Every candidate of every event in scope, found from what was known at its cutoff.

    ``events``: event_id, season, week, season_type, valid_at, home_team, away_team;
    ``revisions`` as for :func:`bitemporal.event_cutoffs`; ``entities``: entity_id,
    position; ``weather``: event_id, era, known_at. An event whose cutoff isn't before its start
    has no candidates but one row for each measure, without an entity, so that it is counted.
    """
    inside = events_in_scope(events, scope.first, scope.last, scope.season_types, scope.limit_events)
    clock = B.event_cutoffs(inside, revisions).drop("known_kickoff_at")
    # One row an event, read by three branches.
    clock = materialize(CX.era_label(clock, weather), "event-clock")
    timely = F.col("cutoff") < F.col("valid_at")
    found = H.candidate_universe(clock.where(timely), versions.where(F.col("measure").isin(*scope.measures)), bucket_seconds).drop("last_team")
    found = found.join(entities.select("entity_id", "position"), "entity_id", "left")
    late = clock.where(~timely).withColumn("measure", F.explode(F.array(*[F.lit(m) for m in scope.measures])))
    rows = found.unionByName(late, allowMissingColumns=True)
    return with_target_ids(rows)


def graded_candidates(
    targets: DataFrame,
    versions: DataFrame,
    actuals: DataFrame,
    registry: DataFrame,
    *,
    bucket_seconds: int | None = None,
    with_drivers: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Every candidate with its projection, actual, baselines and outcome.

    :func:`fitted_candidates`, which does all the shuffling, then :func:`grade`, row by row.
    """
    rows, priors = fitted_candidates(targets, versions, actuals, registry, bucket_seconds=bucket_seconds)
    return grade(rows, registry, with_drivers=with_drivers), priors


#: What :func:`grade` doesn't read of the rows it is given.
UNREAD = ("window_n", "last_season", "ew_zero", "ew_log_mean", "log_sigma", "window_variance", "season_n", "season_total", "sample_players",
          *[f"prior_{c}" for c in ("p_zero", "mu", "sigma", "mean", "variance")])


def fitted_candidates(
    targets: DataFrame, versions: DataFrame, actuals: DataFrame, registry: DataFrame, *, bucket_seconds: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Every candidate with its history, prior, parameters and actual, and the priors.

    ``targets``: target_id, event_id, entity_id, measure, season, position, era,
    valid_at, cutoff. ``actuals``: entity_id, event_id, measure, actual,
    correction_applied (the corrected line; the only read past the cutoff).
    """
    width = bucket_seconds or H.stream_width(targets, versions)
    in_time = F.coalesce(F.col("cutoff") < F.col("valid_at"), F.lit(False))
    timely = targets.where(in_time)
    requests = materialize(P.prior_requests(timely), "prior-requests")
    priors = materialize(P.walk_forward_priors(versions, requests), "priors")
    facts = actuals.select(*B.LINE, "actual", "correction_applied")
    found = H.with_history(timely, versions, facts, width).drop("window")
    late = targets.where(~in_time).join(facts, B.LINE, "left")
    candidates = found.unionByName(late, allowMissingColumns=True)
    return PJ.fitted(candidates, priors, registry), priors


def grade(rows: DataFrame, registry: DataFrame, *, with_drivers: bool = True) -> DataFrame:
    """:func:`fitted_candidates` as graded projections. Nothing is shuffled, so a stored run keeps the narrow rows and grades them as they are read."""
    graded = PJ.described(rows, registry, with_drivers=with_drivers)
    reason = (
        F.when(F.col("cutoff") >= F.col("valid_at"), K.REASON_CUTOFF_AFTER_KICKOFF)
        .when(F.col("sample_games").isNull(), K.REASON_NO_PRIOR)
        .when(F.col("n_eff") < K.MIN_ELIGIBLE_GAMES, K.REASON_INSUFFICIENT_HISTORY)
        .when(F.col("projected_value").isNull() | F.isnan("projected_value"), K.REASON_HARNESS_ERROR)
        .when(F.col("actual").isNull(), K.REASON_NO_ACTUAL)
    )
    outcome = (
        F.when(reason.isNull(), "projected")
        .when(reason == K.REASON_INSUFFICIENT_HISTORY, "unprojectable")
        .otherwise("excluded")
    )
    in_comparison = F.col("season_average").isNotNull() & F.col("trailing_five").isNotNull()
    return graded.withColumns({
        "reason": reason,
        "outcome": outcome,
        "in_comparison_population": in_comparison,
        "contract_like": F.coalesce(F.col("projected_value") >= F.col("floor"), F.lit(False)),
        "prediction_id": keys.prediction_id(
            F.col("event_id"), F.col("entity_id"), F.col("measure"), F.lit(K.MODEL_VERSION), F.col("cutoff")
        ),
    })


def prediction_rows(graded: DataFrame) -> DataFrame:
    """Quantised prediction rows, as written and digested."""
    rows = graded.where(F.col("outcome") == "projected")
    error = F.col("actual") - F.col("projected_value")
    median_error = F.col("actual") - F.col("projected_median")
    rows = rows.withColumns({
        "actual_percentile": D.actual_percentile(F.col("distribution_kind"), F.col("params"), F.col("actual")),
        "abs_error": F.abs(error),
        "sq_error": error * error,
        "abs_error_median": F.abs(median_error),
        "sq_error_median": median_error * median_error,
        "baseline_season_avg": F.col("season_average"),
        "baseline_trailing5": F.col("trailing_five"),
        "baseline_season_avg_abs_error": F.abs(F.col("actual") - F.col("season_average")),
        "baseline_trailing5_abs_error": F.abs(F.col("actual") - F.col("trailing_five")),
    })
    flat = rows.withColumns({n: F.col("quantiles")[n] for n in K.QUANTILE_NAMES})
    keep = [
        "prediction_id", "event_id", "entity_id", "season", "measure", "family", "position", "model_version",
        "distribution_kind", "params", "pmf", "tail_mass", "zero_mass", *K.QUANTILE_NAMES,
        "projected_value", "projected_median", "interval_low", "interval_high", "mass_below_zero",
        "confidence", "n_eff", "relative_width", "cutoff", "valid_at", "era", "actual", "actual_percentile",
        "abs_error", "sq_error", "abs_error_median", "sq_error_median", "baseline_season_avg", "baseline_trailing5",
        "baseline_season_avg_abs_error", "baseline_trailing5_abs_error", "in_comparison_population",
        "correction_applied", "contract_like", "cohorts", "thresholds",
    ]
    keep += [c for c in ("drivers", "era_source", "week", "season_type", "last_team") if c in flat.columns]
    return N.quantise(flat.select(*keep))


def exclusion_detail(reason: Column) -> Column:
    """What the reason means for this row; NULL where it says all. Reads season, measure and position."""
    position = F.coalesce(F.col("position"), F.lit("unknown"))
    return (
        F.when(reason == K.REASON_CUTOFF_AFTER_KICKOFF, "the cutoff is not before the start")
        .when(reason == K.REASON_NO_PRIOR, F.format_string("%s of position %s: nothing published from before season %d", F.col("measure"), position, F.col("season")))
        .when(reason == K.REASON_BASELINE_UNAVAILABLE, "no line of the season was known at the cutoff")
    )


def exclusion_rows(graded: DataFrame) -> DataFrame:
    """One row per removal, or per projection lacking a baseline: no candidate has both, so candidates are read once."""
    removed = F.col("outcome") != "projected"
    reason = F.when(removed, F.col("reason")).otherwise(K.REASON_BASELINE_UNAVAILABLE)
    stage = F.when(F.col("outcome") == "unprojectable", "engine").otherwise("harness")
    return graded.where(removed | ~F.col("in_comparison_population")).select(
        "event_id", "entity_id", "measure", stage.alias("stage"), reason.alias("reason"), F.when(~removed, F.col("prediction_id")).alias("prediction_id"),
        exclusion_detail(reason).alias("detail"),
    )


def backtest_from_events(
    events: DataFrame, revisions: DataFrame, versions: DataFrame, actuals: DataFrame, entities: DataFrame, weather: DataFrame, registry: DataFrame, scope: Scope,
    *, bucket_seconds: int | None = None, with_drivers: bool = True,
) -> Backtest:
    """The whole run from events: cutoffs, candidates, histories, priors, projections, grading.

    Without ``bucket_seconds`` the width of the time buckets is sized by the hottest stream.
    Candidates are stored once; whoever was a candidate and has no line is excluded by name.
    """
    targets = event_targets(events, revisions, versions, entities, weather, scope, bucket_seconds)
    return backtest(targets, versions, actuals, registry, bucket_seconds=bucket_seconds, with_drivers=with_drivers)


def event_targets(
    events: DataFrame, revisions: DataFrame, versions: DataFrame, entities: DataFrame, weather: DataFrame, scope: Scope, bucket_seconds: int | None = None,
) -> DataFrame:
    """:func:`targets_from_events`, stored; the ids, which are made of other columns, are added as they are read."""
    width = bucket_seconds or TL.suggest_width([(versions, "valid_at")], H.STREAM)
    found = targets_from_events(events, revisions, versions, entities, weather, scope, bucket_seconds=width)
    return with_target_ids(materialize(found.drop("target_id"), "targets"))


def with_target_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("target_id", F.concat_ws(":", "event_id", F.coalesce(F.col("entity_id").cast("string"), F.lit("")), "measure"))


def backtest(targets: DataFrame, versions: DataFrame, actuals: DataFrame, registry: DataFrame, **options) -> Backtest:
    graded, priors = graded_candidates(targets, versions, actuals, registry, **options)
    predictions = prediction_rows(graded)
    scored = graded.where(F.col("outcome") == "projected")
    return Backtest(graded, predictions, exclusion_rows(graded), PJ.threshold_rows(scored), priors)


class TooManyFailures(RuntimeError):
    """A systematic fault, not selectivity."""


def check_failures(graded: DataFrame, limit: int = K.MAX_CANDIDATE_ERRORS) -> int:
    """Count candidates the scoring could not handle; refuse a run full of them."""
    failed = graded.where(F.col("reason") == K.REASON_HARNESS_ERROR).count()
    if failed >= limit:
        raise TooManyFailures(f"{failed} candidate failures; aborting")
    return failed
