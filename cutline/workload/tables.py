"""The shared test tables read as stat lines, corrections, schedules and prices.

Every definition here has a twin in ``workload.sql``. An order is one event and
one stat line of its customer; its measures are the price (continuous) and the
number of line items (count). Keys divisible by small primes carry the edge
cases: absent values, zeros, corrections, moved schedules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline import constants as K
from cutline.functions import numbers as N
from cutline.functions import times
from cutline.operators import bitemporal as B
from cutline.operators import registry as R
from cutline.session import materialize, use_utc

STATS = (
    R.StatType("price", K.CONTINUOUS, R.grid(24.5, 424.5, 50.0), None, 50.0),
    R.StatType("lines", K.COUNT, R.grid(1.5, 8.5, 1.0), 15, 2.0),
)


# Declared, never inferred: a read costs no footer job and a drifted file fails.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def every(key: str, n: int):
    return F.col(key) % n == 0


def days(n: int):
    return F.make_dt_interval(F.lit(n))


def hours(n):
    return F.make_dt_interval(F.lit(0), n if not isinstance(n, int) else F.lit(n))


def registry(spark: SparkSession) -> DataFrame:
    return R.registry(spark, STATS)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events of one entity, with both clocks."""
    o = table(spark, sf_dir, "orders")
    valid = F.col("o_orderdate") + hours((F.col("o_orderkey") % 24).cast("int"))
    return o.select(
        F.col("o_custkey").alias("entity_id"),
        F.col("o_orderkey").alias("event_id"),
        F.year("o_orderdate").alias("season"),
        valid.alias("valid_at"),
        F.col("o_totalprice"),
        F.col("o_orderpriority"),
        F.col("o_orderstatus"),
    ).withColumn("published_at", times.published_at(F.col("valid_at")))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("entity_id"),
        F.when(~every("c_custkey", 29), F.col("c_mktsegment")).alias("position"),
        F.col("c_nationkey").alias("home_nation"),
    )


def lines_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.count("*").alias("item_count"))
    base = orders(spark, sf_dir).join(customers(spark, sf_dir), "entity_id").join(items, "event_id", "left")
    price = F.when(every("event_id", 13), None).when(every("event_id", 17), 0.0).otherwise(F.col("o_totalprice") / 1000.0)
    return base.select(
        "entity_id", "event_id", "season", "position",
        ((F.col("home_nation") + F.when(every("event_id", 5), 1).otherwise(0)) % 25).alias("team"),
        "valid_at", "published_at",
        price.alias("price"),
        F.when(~every("event_id", 19), F.coalesce("item_count", F.lit(0))).cast("double").alias("lines"),
    )


def stat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = ["entity_id", "event_id", "season", "position", "team", "valid_at", "published_at"]
    return B.to_long(lines_wide(spark, sf_dir), ids, {"price": "price", "lines": "lines"})


def corrections(lines: DataFrame, key: str = "event_id") -> DataFrame:
    """One correction 45 days on for every 11th ``key``, a second at 90 for every 22nd."""
    changed = lines.where(every(key, 11))
    price = F.col("measure") == "price"
    first = changed.select(
        *B.LINE, F.lit(2).alias("version"), (F.col("valid_at") + days(45)).alias("known_at"),
        (price | ~every(key, 33)).alias("has_prior"),
        F.when(price, F.coalesce(F.col("value") * 0.9, F.lit(100.0))).otherwise(F.coalesce(F.col("value") + 1, F.lit(2.0))).alias("prior_value"),
    )
    second = changed.where(every(key, 22)).select(
        *B.LINE, F.lit(3).alias("version"), (F.col("valid_at") + days(90)).alias("known_at"),
        F.lit(True).alias("has_prior"),
        F.when(price, F.col("value") * 0.95).otherwise(F.when(~every(key, 44), F.col("value") + 2)).alias("prior_value"),
    )
    return first.unionByName(second)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = materialize(stat_lines(spark, sf_dir), "lines")  # read as lines and as what is corrected
    return B.value_versions(lines, corrections(lines))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first schedule 200 days out; every 7th event moves three days before."""
    o = orders(spark, sf_dir)
    shift = F.when(every("event_id", 21), hours(5)).when(every("event_id", 7), hours(-2)).otherwise(hours(0))
    first = o.select(
        "event_id", (F.col("valid_at") + shift).alias("kickoff_at"), (F.col("valid_at") - days(200)).alias("known_at"),
        F.lit(1).alias("revision_seq"),
    )
    moved = o.where(every("event_id", 7)).select(
        "event_id", F.col("valid_at").alias("kickoff_at"), (F.col("valid_at") - days(3)).alias("known_at"),
        F.lit(2).alias("revision_seq"),
    )
    return first.unionByName(moved)


def event_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.event_cutoffs(orders(spark, sf_dir).select("entity_id", "event_id", "season", "valid_at"), revisions(spark, sf_dir))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a target of both measures, at its own derived cutoff."""
    era = F.when(F.col("season") >= 1999, "archived_forecast").otherwise("reanalysis")
    clock = event_clock(spark, sf_dir).join(customers(spark, sf_dir).select("entity_id", "position"), "entity_id")
    return clock.select(
        "entity_id", "event_id", "season", "position", "valid_at", "cutoff", era.alias("era"),
        F.explode(F.array(F.lit("price"), F.lit("lines"))).alias("measure"),
    ).withColumn("target_id", F.concat_ws(":", "event_id", "measure"))


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event a quarter for each nation as home team, near the quarter's end."""
    quarters = table(spark, sf_dir, "orders").select(F.date_trunc("quarter", "o_orderdate").alias("q")).distinct()
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey").crossJoin(quarters).select(
        (n * 100000 + F.datediff("q", F.lit("1990-01-01").cast("date"))).cast("long").alias("event_id"), F.year("q").alias("season"), F.quarter("q").alias("week"),
        F.when(F.quarter("q") == 4, "POST").otherwise("REG").alias("season_type"), n.alias("home_team"), ((n + 7) % 25).alias("away_team"),
        (F.col("q") + days(80) + hours(17)).alias("valid_at"), "q",
    )


def fixture_lines(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """A customer's orders of a quarter as its line of its team's fixture; many entities share an event."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("entity_id"), F.date_trunc("quarter", "o_orderdate").alias("q"), "o_totalprice")
    rows = o.join(customers(spark, sf_dir), "entity_id").join(items, "k", "left")
    price = F.when(every("k", 13), None).when(every("k", 17), 0.0).otherwise(F.col("o_totalprice")).cast("decimal(12,2)")
    rows = rows.select("entity_id", "position", "q", ((F.col("home_nation") + F.when(every("k", 5), 1).otherwise(0)) % 25).alias("team"), price.alias("price"),
                       F.when(~every("k", 19), F.coalesce("n", F.lit(0))).alias("lines"))
    summed = rows.groupBy("entity_id", "position", "q", "team").agg((F.sum("price").cast("double") / 1000.0).alias("price"), F.sum("lines").cast("double").alias("lines"))
    placed = summed.join(events.select("event_id", "season", "valid_at", "q", F.col("home_team").alias("team")), ["q", "team"])
    placed = placed.withColumn("published_at", times.published_at(F.col("valid_at")))
    return B.to_long(placed, ["entity_id", "event_id", "season", "position", "team", "valid_at", "published_at"], {"price": "price", "lines": "lines"})


def fixture_revisions(events: DataFrame) -> DataFrame:
    shift = F.when(every("event_id", 21), hours(5)).when(every("event_id", 7), hours(-2)).otherwise(hours(0))
    first = events.select("event_id", (F.col("valid_at") + shift).alias("kickoff_at"), (F.col("valid_at") - days(60)).alias("known_at"), F.lit(1).alias("revision_seq"))
    return first.unionByName(events.where(every("event_id", 7)).select("event_id", F.col("valid_at").alias("kickoff_at"), (F.col("valid_at") - days(3)).alias("known_at"), F.lit(2).alias("revision_seq")))


def fixture_weather(events: DataFrame) -> DataFrame:
    """A reading for every third event; for the even ones it is known too late."""
    known = F.col("valid_at") - F.when(every("event_id", 2), hours(1)).otherwise(hours(12))
    return events.where(every("event_id", 3)).select("event_id", F.lit("archived_forecast").alias("era"), known.alias("known_at"))


@dataclass(frozen=True)
class FixtureCorpus:
    """Events shared by many entities, with all their lines."""

    events: DataFrame
    versions: DataFrame


_FIXTURES: dict[tuple[str, str], FixtureCorpus] = {}


def fixture_corpus(spark: SparkSession, sf_dir: str) -> FixtureCorpus:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FIXTURES:
        events = materialize(fixtures(spark, sf_dir), "fixtures")
        lines = materialize(fixture_lines(spark, sf_dir, events), "fixture-lines")
        tagged = lines.withColumn("tag", F.col("event_id") + F.col("entity_id"))
        _FIXTURES[key] = FixtureCorpus(events, materialize(B.value_versions(lines, corrections(tagged, "tag")), "fixture-versions"))
    return _FIXTURES[key]


def fixture_actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture_corpus(spark, sf_dir).versions.where("version_seq = 0").select(
        *B.LINE, F.col("value").alias("actual"), ((F.col("event_id") + F.col("entity_id")) % 11 == 0).alias("correction_applied")
    )


@dataclass(frozen=True)
class Corpus:
    """The stored corpus: what an ingest run leaves behind for every reader."""

    versions: DataFrame
    targets: DataFrame


_CORPORA: dict[tuple[str, str], Corpus] = {}


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Versions and targets, written once per application and read by all queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CORPORA:
        _CORPORA[key] = Corpus(
            materialize(versions(spark, sf_dir), "versions"), materialize(targets(spark, sf_dir), "targets")
        )
    return _CORPORA[key]


def actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrected line of each event; version_seq 0 is the current one."""
    return corpus(spark, sf_dir).versions.where("version_seq = 0").select(
        *B.LINE, F.col("value").alias("actual"), every("event_id", 11).alias("correction_applied")
    )


def price_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a four-sided book per contract."""
    e = table(spark, sf_dir, "events")
    ask = N.book_side(F.col("value"))
    bid = N.book_side(ask - 2)
    return e.select(
        F.col("event_id").alias("observation_id"), F.col("user_id").alias("contract_id"), F.col("ts").alias("observed_at"),
        bid.alias("yes_bid"), ask.alias("yes_ask"),
        N.book_side(100 - ask).alias("no_bid"), N.book_side(100 - bid).alias("no_ask"),
    )
