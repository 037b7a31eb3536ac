"""Walk-forward population priors: earlier seasons only, as published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline import constants as K

LOG_SCALE = "decimal(24,12)"
VALUE_SCALE = "decimal(26,6)"
KEY = ["season", "measure", "position"]


def prior_requests(targets: DataFrame) -> DataFrame:
    """One row per (season, measure, position) with the cutoff it is fitted at.

    A prior is fitted once, at the cutoff of the first event that needs it, and
    serves the whole season.
    """
    return targets.where(F.col("position").isNotNull()).groupBy(*KEY).agg(
        F.min_by("cutoff", F.struct("valid_at", "event_id")).alias("prior_cutoff")
    )


def moments(value: Column) -> list[Column]:
    """Order-independent sums: logs and values are quantised to decimals first."""
    positive = F.when(value > 0, value)
    log = F.log(positive).cast(LOG_SCALE)
    number = value.cast(VALUE_SCALE)
    return [
        F.count(value).alias("sample_games"),
        F.count(positive).alias("n_positive"),
        F.sum(log).alias("log_sum"),
        F.sum((log * log).cast(LOG_SCALE)).alias("log_sq"),
        F.sum(number).alias("total"),
        F.sum((number * number).cast("decimal(38,6)")).alias("total_sq"),
    ]


def _variance(n: Column, total: Column, total_sq: Column) -> Column:
    """Sample variance from exact sums; the difference is taken in decimals."""
    scaled = n.cast("double") * total_sq.cast("double") - total.cast("double") * total.cast("double")
    return F.when(n >= 2, F.greatest(scaled, F.lit(0.0)) / (n.cast("double") * F.when(n >= 2, n - 1)))


def fitted(df: DataFrame) -> DataFrame:
    """Both families' parameters from the columns of :func:`moments`."""
    n, pos = F.col("sample_games"), F.col("n_positive")
    log_mean = F.col("log_sum").cast("double") / F.when(pos > 0, pos)
    log_sd = F.sqrt(_variance(pos, F.col("log_sum"), F.col("log_sq")))
    floor = F.lit(K.SIGMA_FLOOR)
    mean = F.col("total").cast("double") / n
    return df.withColumns({
        "p_zero": F.lit(1.0) - pos / n,
        "mu": F.coalesce(log_mean, F.lit(0.0)),
        "sigma": F.greatest(F.coalesce(log_sd, floor), floor),
        "mean": mean,
        "variance": F.coalesce(_variance(n, F.col("total"), F.col("total_sq")), mean * K.COUNT_MIN_DISPERSION),
    }).drop("n_positive", "log_sum", "log_sq", "total", "total_sq")


def walk_forward_priors(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """Fit every requested prior.

    The requests are one row per (season, stat type, position). Pass them as a
    stored table: the planner then sees that they are small and broadcasts them, as
    one row per (stat type, position), so the evidence is summed before any shuffle and a
    position holding most rows costs no more than its scan. Were they large, the same join
    shuffles. Players are counted apart from the sums, which would else be shuffled once a player.
    """
    asked = requests.groupBy("measure", "position").agg(F.collect_list(F.struct("season", "prior_cutoff")).alias("asked"))
    evidence = versions.where(F.col("value").isNotNull()).select(
        "entity_id", "measure", "position", F.col("season").alias("seen_season"), "value", "visible_from", "visible_to"
    )

    def serves(ask: Column) -> Column:
        return (
            (F.col("seen_season") < ask["season"])
            & (F.col("visible_from") <= ask["prior_cutoff"])
            & (F.col("visible_to").isNull() | (F.col("visible_to") > ask["prior_cutoff"]))
        )

    joined = evidence.join(asked, ["measure", "position"])
    served = joined.withColumn("seasons", F.transform(F.filter("asked", serves), lambda a: a["season"])).where(F.size("seasons") > 0)
    sums = served.select("measure", "position", "seen_season", "value", F.explode("seasons").alias("season")).groupBy(*KEY).agg(
        *moments(F.col("value")), F.array_sort(F.collect_set("seen_season")).alias("fitted_from_seasons"),
    )
    # A player's seasons become one set, so a player meets in one place once, whatever the number of seasons asked for.
    per = served.where(F.col("entity_id").isNotNull()).groupBy("entity_id", "measure", "position").agg(F.collect_set("seasons").alias("sets"))
    players = per.select("measure", "position", F.explode(F.array_distinct(F.flatten("sets"))).alias("season")).groupBy(*KEY).agg(F.count("*").alias("sample_players"))
    both = sums.join(players, KEY, "left").withColumn("sample_players", F.coalesce("sample_players", F.lit(0)))
    return fitted(both.select(*KEY, "sample_games", "n_positive", "log_sum", "log_sq", "total", "total_sq", "sample_players", "fitted_from_seasons"))


def population_moments(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Log-normal and count moments per key, with no walk-forward bound."""
    return fitted(df.where(F.col(value).isNotNull()).groupBy(*keys).agg(*moments(F.col(value))))
