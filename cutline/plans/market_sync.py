"""Market sync: parse, resolve, merge, observe, delist, and say how it went."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline import constants as K
from cutline.functions import numbers as N
from cutline.functions import rows as RW
from cutline.operators import identity as ID
from cutline.operators import market as MK
from cutline.operators import merges as MG
from cutline.operators import timeline as TL
from cutline.operators.scalars import with_row
from cutline.session import materialize


@dataclass(frozen=True)
class MarketSync:
    contracts: DataFrame
    observations: DataFrame
    mappings: DataFrame
    status: DataFrame


def books(markets: DataFrame, observed_at: Column) -> DataFrame:
    return markets.select("ticker", observed_at.alias("observed_at"), *[N.book_side(F.col(s)).alias(s) for s in MK.SIDES])


def due_observations(incoming: DataFrame, latest: DataFrame, heartbeat_minutes: int = K.PRICE_HEARTBEAT_MINUTES) -> DataFrame:
    """Books to append: changed since the last stored one, or a heartbeat old."""
    last = latest.select("ticker", F.col("observed_at").alias("__at"), *[F.col(s).alias(f"__{s}") for s in MK.SIDES])
    both = incoming.join(last, "ticker", "left")
    moved = RW.book_differs([F.col(s) for s in MK.SIDES], [F.col(f"__{s}") for s in MK.SIDES])
    old = F.unix_millis("observed_at") - F.unix_millis("__at") >= heartbeat_minutes * 60000
    return both.where(F.col("__at").isNull() | moved | old).select(*incoming.columns)


def market_sync(markets: DataFrame, failures: DataFrame, contracts: DataFrame, latest_books: DataFrame, events: DataFrame,
                players: DataFrame, mappings: DataFrame, observed_at: Column) -> MarketSync:
    """``failures``: one row per failed series or market; empty when all came in.

    Listings and people come in small files, but each of their texts is taken apart: they are dealt
    to all tasks first, and what is read off them is stored for the outputs that need it.
    """
    markets = materialize(ID.parse_markets(markets.repartition("ticker")), "parsed")
    index = materialize(ID.player_index(players.repartition("entity_id")), "player-names")
    resolved = ID.resolve_contracts(markets, events, players, mappings, index)
    incoming = resolved.select(
        "ticker", "series", "entity_id", "event_id", "stat_type", "threshold", "resolution_status", "resolution_note",
        F.try_to_timestamp("close_time").alias("close_time"),
    )
    merged = MG.contract_merge(contracts, incoming.drop("series"), observed_at).current
    counted = with_row(failures.agg(F.count("*").alias("failures")), markets.agg(F.count("*").alias("discovered")))
    gone = MG.delist(contracts, markets, counted) if "series" in contracts.columns else MG.delist(contracts.withColumn("series", F.lit("")), markets, counted)
    final = merged.join(gone.select("ticker", F.lit(True).alias("__gone")), "ticker", "left").withColumn(
        "status", F.when(F.col("__gone"), "delisted").otherwise(F.col("status"))
    ).drop("__gone")
    status = counted.select("*", RW.sync_status(F.col("failures"), F.col("discovered"), F.col("discovered")).alias("status"))
    return MarketSync(final, due_observations(books(markets, observed_at), latest_books), ID.new_mappings(markets, players, index=index), status)


def price_refresh(sync: MarketSync, events: DataFrame, stored_snapshots: DataFrame, projections: DataFrame, prices: DataFrame, now: Column) -> DataFrame:
    """After a sync, freeze the final rows of contracts about to start."""
    contracts = sync.contracts.withColumn("contract_id", F.col("ticker"))
    return MK.final_snapshots(contracts, events, stored_snapshots, projections, prices, now)


CONTRACT = ("ticker string, series string, entity_id long, event_id long, stat_type string, threshold double, resolution_status string, resolution_note string, "
            "status string, close_time timestamp, first_seen_at timestamp, last_seen_at timestamp")
OBSERVATION = "ticker string, observed_at timestamp, yes_bid int, yes_ask int, no_bid int, no_ask int"
MAPPING = "external_name string, entity_id long, status string, updated_at timestamp"
SYNC = "failures long, discovered long, status string"


class MarketStore:
    """The tables of market ticks under one folder: what a tick changed, and a marker that it is complete.

    A tick writes its rows under ``<table>/tick=<n>`` and its marker last, so a tick that
    stops half-way has written nothing that is read, and its replay writes the same places anew.
    The current state is the latest row of each key among complete ticks. Ticks are numbered from 0.
    """

    TABLES = {"contracts": CONTRACT, "observations": OBSERVATION, "mappings": MAPPING, "syncs": SYNC}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _scan(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, tick long").parquet(f"{self.root}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, tick long")

    def rows(self, table: str, before: int | None = None) -> DataFrame:
        """Rows of complete ticks (under ``before``), with their ``tick``."""
        done = self._scan("complete", "at timestamp").select("tick")
        out = self._scan(table, self.TABLES[table]).join(done, "tick", "left_semi")
        return out if before is None else out.where(F.col("tick") < before)

    def contracts(self, before: int | None = None) -> DataFrame:
        return TL.latest_per_key(self.rows("contracts", before), ["ticker"], ["tick"]).drop("tick")

    def mappings(self, before: int | None = None) -> DataFrame:
        return TL.latest_per_key(self.rows("mappings", before), ["external_name"], ["tick"]).drop("tick")

    def latest_books(self, before: int | None = None) -> DataFrame:
        return TL.latest_per_key(self.rows("observations", before), ["ticker"], ["tick", "observed_at"]).drop("tick")

    def tick(self, n: int, markets: DataFrame, failures: DataFrame, events: DataFrame, players: DataFrame, observed_at: Column, mappings: DataFrame | None = None) -> None:
        """One sync from the state of the ticks before ``n``. ``mappings`` (manual ones, say) stand before those that ticks have recorded.

        A partial or empty discovery delists nothing. Only contracts that changed are written.
        """
        stored, known = self.contracts(n), self.mappings(n)
        if mappings is not None:
            known = known.join(mappings.select("external_name"), "external_name", "left_anti").unionByName(mappings)
        stored, known, last = materialize(stored, "contracts"), materialize(known, "mappings"), materialize(self.latest_books(n), "books")
        sync = market_sync(markets, failures, stored, last, events, players, known, observed_at)
        series = stored.select("ticker", "series").unionByName(markets.select("ticker", "series")).groupBy("ticker").agg(F.min("series").alias("series"))
        whole = sync.contracts.join(series, "ticker")
        columns = [c.split()[0] for c in CONTRACT.split(", ")]
        before = stored.select("ticker", F.struct(*columns).alias("__before"))
        changed = whole.join(before, "ticker", "left").where(~F.struct(*columns).eqNullSafe(F.col("__before"))).select(*columns)
        fresh = sync.mappings.where(F.col("status") == "resolved").join(known, "external_name", "left_anti")
        made = {"contracts": changed, "observations": sync.observations, "syncs": sync.status,
                "mappings": fresh.select("external_name", "entity_id", "status", observed_at.alias("updated_at"))}
        for table, rows in made.items():
            typed = rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in self.TABLES[table].split(", ")])
            typed.write.mode("overwrite").parquet(f"{self.root}/{table}/tick={n}")
        self.spark.range(1).select(observed_at.alias("at")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/complete/tick={n}")
