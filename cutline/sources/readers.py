"""Landed files to DataFrames, with contracts checked before any action."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutline import constants as K

# Declared schemas of the season-bounded sources.
SOURCE_SCHEMAS = {
    "teams": "team_abbr string, team_name string, team_conf string, team_division string",
    "players": "gsis_id string, display_name string, position string, birth_date string, latest_team string, pfr_id string, espn_id string",
    "schedule": "game_id string, season int, week int, game_type string, gameday string, gametime string, home_team string, "
                "away_team string, roof string, stadium string, location string, result int",
    "pbp": "game_id string, season int, play_id int, qtr int, game_seconds_remaining int, posteam string, down int, ydstogo int, "
           "yardline_100 int, play_type string, yards_gained int, pass int, rush int, touchdown int, passer_player_id string, "
           "rusher_player_id string, receiver_player_id string, epa double, wp double",
    "stats": "player_id string, game_id string, season int, team string, passing_yards double, passing_tds int, attempts int, "
             "completions int, passing_interceptions int, rushing_yards double, rushing_tds int, carries int, receiving_yards double, "
             "receiving_tds int, receptions int, targets int",
    "snap_counts": "game_id string, season long, pfr_player_id string, team string, offense_snaps double, offense_pct double, "
                   "defense_snaps double, defense_pct double, st_pct double",
    "injuries": "season long, week long, team string, gsis_id string, report_status string, practice_status string, date_modified string",
}
SEASONAL = ("schedule", "pbp", "stats", "snap_counts", "injuries")

MARKET_SCHEMA = (
    "ticker string, event_ticker string, title string, yes_sub_title string, status string, close_time string, "
    "yes_bid double, yes_ask double, no_bid double, no_ask double, floor_strike double"
)
PLAY_PAYLOAD = (
    "posteam", "down", "ydstogo", "yardline_100", "play_type", "yards_gained", "pass", "rush", "touchdown",
    "passer_player_id", "rusher_player_id", "receiver_player_id", "wp",
)


class SchemaDrift(ValueError):
    """A source arrived without a column its readers need."""


class UsageError(ValueError):
    """The caller asked for something the job cannot mean."""


def require_columns(df: DataFrame, columns: list[str], dataset: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaDrift(f"{dataset}: upstream schema drift - missing column(s): {missing}")
    return df


def season_range(first: int | None, last: int | None) -> list[int]:
    if first is None or last is None:
        raise UsageError("this dataset requires seasons (e.g. 1999-2025)")
    return list(range(first, last + 1))


def parse_seasons(text: str) -> tuple[int, int]:
    first, _, last = text.partition("-")
    try:
        low, high = int(first), int(last or first)
    except ValueError:
        raise UsageError(f"not a season range: {text!r}") from None
    if low > high:
        raise UsageError(f"season range runs backwards: {text!r}")
    return low, high


def read_source(spark: SparkSession, path: str, dataset: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """A landed source; seasonal ones are bounded, so partitions are pruned.

    The contract is checked against the file's own columns, because a declared
    schema would read a renamed column as NULLs.
    """
    schema = SOURCE_SCHEMAS[dataset]
    wanted = [f.name for f in T.StructType.fromDDL(schema).fields]
    require_columns(spark.read.parquet(path), wanted, dataset)
    df = spark.read.schema(schema).parquet(path)
    if dataset not in SEASONAL:
        return df
    seasons = season_range(first, last)
    return df.where(F.col("season").between(seasons[0], seasons[-1]))


def read_samples(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Name samples: JSON strings or objects, alone or in a list, or an object wrapping such a list.

    A file is one JSON value, or, with ``lines``, each of its lines is one; then a file is split
    among tasks and no value but a line is held whole. A line that is no JSON has no name and id.
    """
    return sample_rows(spark.read.text(path, wholetext=not lines))


def sample_rows(values: DataFrame) -> DataFrame:
    """(name, id) of every sample in the JSON texts ``value``; the id is an object's id, ticker or name."""
    raw = values.select(F.try_parse_json("value").alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$.players", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    rows = raw.select(F.explode(items).alias("i"))
    field = lambda f: F.try_variant_get("i", f"$.{f}", "string")
    is_text = F.schema_of_variant("i") == "STRING"
    plain = F.when(is_text, F.try_variant_get("i", "$", "string"))
    name = F.coalesce(plain, field("name"))
    return rows.select(name.alias("name"), F.coalesce(plain, field("id"), field("ticker"), name).alias("id"))


def require_named(samples: DataFrame) -> DataFrame:
    bad = samples.where(F.col("name").isNull() | (F.col("name") == "")).count()
    if bad:
        raise SchemaDrift(f"{bad} sample entr(ies) carry no name")
    return samples


def read_market_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed listing pages to one row per market, with the series that listed it."""
    pages = spark.read.schema(f"series string, markets array<struct<{', '.join(c.strip().replace(' ', ': ', 1) for c in MARKET_SCHEMA.split(','))}>>").json(path)
    return pages.select("series", F.explode("markets").alias("m")).select("series", "m.*")


def pack_payload(df: DataFrame, columns: tuple[str, ...] = PLAY_PAYLOAD, name: str = "payload", *, as_json: bool = False) -> DataFrame:
    """Chosen columns folded into one value; the rest stay as they are."""
    packed = F.struct(*columns)
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, (F.to_json(packed) if as_json else packed).alias(name))


def read_dataset(spark: SparkSession, root: str, dataset: str, schema: T.StructType | str) -> DataFrame:
    """An artefact dataset; a run that never wrote it reads as empty."""
    try:
        return spark.read.schema(schema).parquet(f"{root}/{dataset}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def covered_seasons(facts: dict[str, DataFrame], ledger: DataFrame) -> DataFrame:
    """(dataset, season) with facts, less the seasons the ledger vetoes."""
    out = None
    for name, df in facts.items():
        part = df.select(F.lit(name).alias("dataset"), F.col("season").cast("int").alias("season")).distinct()
        out = part if out is None else out.unionByName(part)
    veto = ledger.where(F.col("coverage") == "none").select("dataset", F.col("season").cast("int").alias("season"))
    return out.join(veto, ["dataset", "season"], "left_anti")


def uncovered_seasons(covered: DataFrame, first: int, last: int, datasets: tuple[str, ...] = K.REQUIRED_COVERAGE_DATASETS) -> DataFrame:
    """Requested (dataset, season) pairs with no coverage."""
    asked = covered.sparkSession.createDataFrame([(d, s) for d in datasets for s in range(first, last + 1)], "dataset string, season int")
    return asked.join(covered, ["dataset", "season"], "left_anti")


def require_coverage(covered: DataFrame, first: int, last: int, datasets: tuple[str, ...] = K.REQUIRED_COVERAGE_DATASETS) -> None:
    missing = uncovered_seasons(covered, first, last, datasets).orderBy("dataset", "season").collect()
    if missing:
        listed = ", ".join(f"{r['dataset']} {r['season']}" for r in missing)
        raise UsageError(f"seasons {first}-{last} are outside recorded coverage: missing {listed}")


def coverage_ledger(source: str, dataset: str, requested: list[int], facts: DataFrame) -> DataFrame:
    """One ledger row per requested season: full where facts exist, else none."""
    asked = facts.sparkSession.createDataFrame([(s,) for s in requested], "season int")
    present = facts.select(F.col("season").cast("int").alias("season")).distinct().withColumn("__p", F.lit(True))
    seen = F.col("__p").isNotNull()
    note = F.concat(F.lit(f"no {dataset} coverage upstream for "), F.col("season").cast("string"))
    return asked.join(present, "season", "left").select(
        F.lit(source).alias("source"), F.lit(dataset).alias("dataset"), "season",
        F.when(seen, "full").otherwise("none").alias("coverage"), F.when(~seen, note).alias("note"),
    )


def merge_ledger(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Latest statement per (source, dataset, season) wins."""
    return current.join(incoming, ["source", "dataset", "season"], "left_anti").unionByName(incoming)
