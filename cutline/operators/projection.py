"""From form features and a prior to a full projection row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline import constants as K
from cutline.functions import distributions as D
from cutline.functions import numbers as N
from cutline.functions import times
from cutline.operators import metrics as MT

PARAMS = ("p_zero", "mu", "sigma", "r", "p")


def _if(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def fit(df: DataFrame) -> DataFrame:
    """Shrunk parameters per family.

    Needs family, n_eff, the columns of ``history.form_features`` and the prior
    as prior_p_zero, prior_mu, prior_sigma, prior_mean, prior_variance.
    Location follows recent form; dispersion uses the whole window unweighted.
    """
    cont, count = F.col("family") == K.CONTINUOUS, F.col("family") == K.COUNT
    n = F.col("n_eff")
    zero = F.lit(0.0)

    def shrunk(sample: str, prior: str) -> Column:
        return D.shrink(F.col(sample), n, F.coalesce(F.col(prior), zero))

    stage = df.withColumns({
        "p_zero": _if(cont, F.least(F.greatest(shrunk("ew_zero", "prior_p_zero"), zero), F.lit(1.0))),
        "mu": _if(cont, shrunk("ew_log_mean", "prior_mu")),
        "sigma": _if(cont, F.greatest(shrunk("log_sigma", "prior_sigma"), F.lit(K.SIGMA_FLOOR))),
        "__m": _if(count, F.greatest(shrunk("ew_mean", "prior_mean"), F.lit(K.COUNT_MEAN_FLOOR))),
        "__v": _if(count, shrunk("window_variance", "prior_variance")),
    })
    nb = D.nb_fit(F.col("__m"), F.col("__v"))
    return stage.withColumns({"r": nb["r"], "p": nb["p"]}).drop("__m", "__v")


def describe(df: DataFrame) -> DataFrame:
    """Kind, quantiles, interval, PMF, threshold probabilities, confidence and cohorts from parameters."""
    cont, count = F.col("family") == K.CONTINUOUS, F.col("family") == K.COUNT
    zil = (F.col("p_zero"), F.col("mu"), F.col("sigma"))
    cap = F.coalesce(F.col("pmf_cap"), F.lit(K.DEFAULT_PMF_CAP))
    named = F.lit(list(K.QUANTILE_NAMES))
    # Two functions, so that a reader of one side doesn't pay for the other; where both are read they share a pass.
    scored = df.withColumns({
        "__s": D.shape_table("family", *PARAMS, F.when(count, cap)),
        "__t": D.tail_table("family", *PARAMS, "thresholds"),
    })
    staged = scored.withColumns({
        "distribution_kind": F.when(cont, K.KIND_ZIL).when(count, K.KIND_NB),
        "params": F.struct(*PARAMS),
        "projected_value": F.when(cont, D.zil_mean(*zil)).when(count, D.nb_mean(F.col("r"), F.col("p"))),
        "quantiles": F.map_from_arrays(named, F.when(cont | count, F.col("__s")["quantiles"])),
        "pmf": F.when(count, F.col("__s")["pmf"]),
        "probabilities": F.when(cont | count, F.col("__t")),
        "mass_below_zero": F.lit(0.0),
    }).drop("__s", "__t")
    q = F.col("quantiles")
    staged = staged.withColumns({
        "projected_median": q["q50"],
        "interval_low": q["q10"],
        "interval_high": q["q90"],
        "tail_mass": F.when(count, D.nb_tail_mass(F.col("pmf"))),
        "zero_mass": F.when(count, F.col("pmf")[0]),
    })
    width = D.relative_width(F.col("family"), F.col("projected_value"), F.col("interval_low"), F.col("interval_high"))
    staged = staged.withColumn("relative_width", width)
    label = D.confidence(F.col("family"), F.col("n_eff"), F.col("relative_width"))
    staged = staged.withColumn("confidence", F.when(F.col("relative_width").isNotNull(), label))
    cohorts = F.array_sort(F.array_compact(F.array(
        F.when(F.col("n_eff") < K.MIN_HISTORY_FOR_MEDIUM, "sparse"),
        F.when(F.col("confidence") == "low", "low_confidence"),
        F.when(times.is_returning(F.col("valid_at"), F.col("last_valid_at")), "returning"),
        F.when(F.col("mass_below_zero") > 0, "impossible_output"),
    )))
    return staged.withColumn("cohorts", cohorts)


def drivers(df: DataFrame) -> Column:
    """Deterministic sentences naming only values the projection used."""
    label = F.replace(F.col("measure"), F.lit("_"), F.lit(" "))
    weight = D.prior_weight(F.col("n_eff"))
    pct = F.bround(weight * 100, 0)
    seasons = F.col("fitted_from_seasons")
    return F.array_compact(F.array(
        F.format_string(
            "%d eligible prior games; exponentially-weighted form %.1f %s.",
            F.col("n_eff"), F.bround("ew_mean", 1), label,
        ),
        F.format_string(
            "Shrunk %.0f%% toward the %s prior for %d, fitted on %d–%d (%,d player-games).",
            pct, F.col("position"), F.col("season"), seasons[0], F.element_at(seasons, -1), F.col("sample_games"),
        ),
        F.when(
            F.col("zero_rate") > 0,
            F.format_string("Produced nothing in %.0f%% of eligible games in the form window.", F.bround(F.col("zero_rate") * 100, 0)),
        ),
        F.when(F.col("crosses_season"), F.lit("Form window crosses a season boundary.")),
        F.format_string("Projected value %.1f, prior weight %.2f.", F.bround("projected_value", 1), F.bround(weight, 2)),
    ))


def project(candidates: DataFrame, priors: DataFrame, registry: DataFrame, *, with_drivers: bool = True) -> DataFrame:
    """Full projection rows; a candidate with no history or no prior gets NULLs
    and keeps its row, so that its outcome can be named."""
    return described(fitted(candidates, priors, registry), registry, with_drivers=with_drivers)


def fitted(candidates: DataFrame, priors: DataFrame, registry: DataFrame) -> DataFrame:
    """Candidates with their prior and their parameters: all that :func:`described` needs, and all that costs a shuffle."""
    prior_cols = priors.select(
        "season", "measure", "position", "sample_games", "sample_players", "fitted_from_seasons",
        *[F.col(c).alias(f"prior_{c}") for c in ("p_zero", "mu", "sigma", "mean", "variance")],
    )
    # The registry has one row per stat type. The hint matters when a caller's
    # stat type is a constant: the equality then folds away and an unhinted join
    # would become a cartesian product. Stored priors are sized by the planner.
    joined = candidates.join(F.broadcast(registry.select("measure", "family")), "measure").join(prior_cols, ["season", "measure", "position"], "left")
    ready = joined.withColumn("n_eff", F.coalesce("n_eff", F.lit(0)))
    return fit(ready.withColumn("family", F.when(_usable(), F.col("family")))).drop("family")


def _usable() -> Column:
    return (F.col("n_eff") >= K.MIN_ELIGIBLE_GAMES) & F.col("sample_games").isNotNull()


def described(rows: DataFrame, registry: DataFrame, *, with_drivers: bool = True) -> DataFrame:
    """:func:`fitted` rows as projections: row by row, so they may be stored narrow and described when they are read."""
    known = rows.join(F.broadcast(registry), "measure").withColumnRenamed("family", "stat_family")
    out = describe(known.withColumn("family", F.when(_usable(), F.col("stat_family"))))
    if with_drivers:
        out = out.withColumn("drivers", F.when(_usable(), drivers(out)))
    return out.drop("family").withColumnRenamed("stat_family", "family").withColumn("model_version", F.lit(K.MODEL_VERSION))


def threshold_rows(predictions: DataFrame) -> DataFrame:
    """(prediction, threshold): the probability that was scored with the projection, and the outcome.

    ``leads`` marks the first row of each prediction and ``leads_bin`` its first row in each
    calibration bin, so that whoever counts predictions needs no distinct and no shuffle.
    """
    scored = predictions.withColumn("__p", F.transform("probabilities", lambda p: N.half_even(p, 6)))
    binned = scored.withColumn("__b", F.transform("__p", lambda p: MT.bin_of(p)))
    exploded = binned.select(
        "prediction_id", "measure", "season", "era", "actual", "contract_like", "__b", F.posexplode(F.arrays_zip("thresholds", F.col("__p").alias("probability"))).alias("i", "t"),
    )
    leads_bin = F.array_position("__b", F.element_at("__b", F.col("i") + 1)) == F.col("i") + 1
    return exploded.select(
        "prediction_id", F.col("measure").alias("stat_type"), "season", "era", F.col("t.thresholds").alias("threshold"),
        F.col("t.probability").alias("probability"), (F.col("actual") >= F.col("t.thresholds")).alias("outcome"), "contract_like",
        (F.col("i") == 0).alias("leads"), F.coalesce(leads_bin, F.col("t.probability").isNull()).alias("leads_bin"),
    )
