"""Sources and sinks over the shared tables: written out, read back, compared; and merges as whole rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.operators import merges as MG
from cutline.session import checkpoint_dir, use_utc
from cutline.sources import readers as SR
from cutline.sources import writers as SW
from cutline.workload import ingest_queries as IQ
from cutline.workload import sql as S
from cutline.workload import tables as T
from cutline.workload.catalog import query


def new_root(spark: SparkSession) -> str:
    use_utc(spark)
    return f"{checkpoint_dir(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"


@query("""
select c_name as name, case c_custkey % 5 when 1 then c_custkey::varchar when 2 then 'T' || c_custkey when 3 then 'P' || c_custkey else c_name end as id from customer
union all select c_name || ' II', c_name || ' II' from customer where c_custkey % 5 in (3, 4)
union all select null, null from customer where c_custkey % 100 = 0""")
def polymorphic_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples landed as lines: strings, objects by id or ticker, wrapped lists, bare lists, and lines that are no JSON."""
    root, c = new_root(spark), T.table(spark, sf_dir, "customer")
    key, name = F.col("c_custkey"), F.col("c_name")
    text = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    pair = lambda k, v: F.concat(F.lit(f'"{k}": "'), v, F.lit('"'))
    later = text(F.concat(name, F.lit(" II")))
    line = (
        F.when(key % 5 == 0, text(name))
        .when(key % 5 == 1, F.concat(F.lit("{"), pair("name", name), F.lit(', "id": '), key.cast("string"), F.lit(', "ticker": "x"}')))
        .when(key % 5 == 2, F.concat(F.lit("{"), pair("ticker", F.concat(F.lit("T"), key)), F.lit(", "), pair("name", name), F.lit("}")))
        .when(key % 5 == 3, F.concat(F.lit('{"players": [{'), pair("id", F.concat(F.lit("P"), key)), F.lit(", "), pair("name", name), F.lit("}, "), later, F.lit("]}")))
        .otherwise(F.concat(F.lit("["), text(name), F.lit(", "), later, F.lit("]")))
    )
    broken = c.where(T.every("c_custkey", 100)).select(F.lit("{not json").alias("value"))
    c.select(line.alias("value")).unionByName(broken).write.text(f"{root}/samples")
    return SR.read_samples(spark, f"{root}/samples", lines=True).select("name", "id")


@query("""
select o_orderkey::varchar as gsis_id, year(o_orderdate)::bigint as season, month(o_orderdate)::bigint as week, o_orderpriority as team, o_orderstatus as report_status
from orders where year(o_orderdate) between (select min(year(o_orderdate)) + 1 from orders) and (select max(year(o_orderdate)) - 1 from orders)""")
def seasonal_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landed seasonal source, partitioned by season, read over a range of seasons."""
    root, o = new_root(spark), T.table(spark, sf_dir, "orders")
    landed = o.select(
        F.year("o_orderdate").cast("long").alias("season"), F.month("o_orderdate").cast("long").alias("week"), F.col("o_orderpriority").alias("team"),
        F.col("o_orderkey").cast("string").alias("gsis_id"), F.col("o_orderstatus").alias("report_status"), F.lit(None).cast("string").alias("practice_status"),
        F.col("o_orderdate").cast("string").alias("date_modified"),
    )
    landed.write.partitionBy("season").parquet(f"{root}/injuries")
    years = landed.agg(F.min("season").alias("a"), F.max("season").alias("b")).first()
    rows = SR.read_source(spark, f"{root}/injuries", "injuries", years.a + 1, years.b - 1)
    return rows.select("gsis_id", "season", "week", "team", "report_status")


@query("select 'S' || (p_partkey % 5) as series, 'T' || p_partkey as ticker, p_name as title, p_size::double as yes_bid, case when p_size % 3 = 0 then p_retailprice end as floor_strike from part")
def market_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages of many markets each, landed as lines of JSON, read back to a row for each market."""
    root, p = new_root(spark), T.table(spark, sf_dir, "part")
    market = F.struct(
        F.concat(F.lit("T"), "p_partkey").alias("ticker"), F.col("p_name").alias("title"), F.col("p_size").cast("double").alias("yes_bid"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice")).alias("floor_strike"),
    )
    page = F.floor(F.col("p_partkey") / 100)  # a page holds at most a hundred parts
    pages = p.groupBy(F.concat(F.lit("S"), F.col("p_partkey") % 5).alias("series"), page.alias("page")).agg(F.collect_list(market).alias("markets"))
    pages.select("series", "markets").write.json(f"{root}/pages")
    return SR.read_market_pages(spark, f"{root}/pages").select("series", "ticker", "title", "yes_bid", "floor_strike")


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where o_custkey % 2 = 1")
def export_and_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exported run read back by name; rows already stored stay out."""
    root, o = new_root(spark), T.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    SW.export_run(o, f"{root}/run")
    return SW.reload_run(spark, f"{root}/run", o.where(F.col("o_custkey") % 2 == 0), ["o_orderkey"])


@query("select o_orderkey, o_custkey, o_orderstatus, year(o_orderdate)::int as season from orders")
def dataset_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An artefact dataset written by season with its manifest and marker, and read back once complete."""
    root = new_root(spark)
    rows = T.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.year("o_orderdate").alias("season"))
    SW.write_dataset(rows, root, "predictions")
    SW.write_manifest(spark, root, {"rows": rows.count()})
    SW.mark_complete(spark, root)
    back = SR.read_dataset(spark, root, "predictions", rows.schema)
    return back.where(F.lit(SW.is_complete(spark, root)) & (F.lit(SW.read_manifest(spark, root)["rows"]) >= 0))


@query(f"""
with {IQ._MERGE}
select coalesce(c.k, i.k) as k, case when i.k is null or c.k is not null and c.segment is not distinct from i.segment then c.name else i.name end as name,
       case when i.k is null then c.segment else i.segment end as segment from current_ c full join incoming i on i.k = c.k""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole merged table of an upsert."""
    current, incoming = IQ.upsert_sides(spark, sf_dir)
    return MG.upsert_if_distinct(current, incoming, ["k"], ["name", "segment"]).current


_DELIVERIES = S.with_(S.LINES) + """,
cur as (select * from lines_wide where event_id % 3 <> 2),
inc as (select *, case when event_id % 8 = 0 then price + 5 when event_id % 12 = 0 then null else price end as new_price from lines_wide where event_id % 6 <> 1)"""


@query(_DELIVERIES + """
select coalesce(c.entity_id, i.entity_id) as entity_id, coalesce(c.event_id, i.event_id) as event_id,
       case when i.event_id is null then c.price else i.new_price end as price,
       case when c.event_id is not null and i.event_id is not null and c.price is distinct from i.new_price then 2 else 1 end as version
from cur c full join inc i on i.entity_id = c.entity_id and i.event_id = c.event_id""")
def correction_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line after two deliveries, with its version."""
    return IQ.two_deliveries(spark, sf_dir).current.select("entity_id", "event_id", "price", "version")


@query(_DELIVERIES + """
select c.entity_id, c.event_id, 2 as version, c.price::double as prior_price, i.new_price::double as corrected_price
from cur c join inc i on i.entity_id = c.entity_id and i.event_id = c.event_id where c.price is distinct from i.new_price""")
def correction_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every logged correction with both snapshots."""
    log = IQ.two_deliveries(spark, sf_dir).log
    return log.select("entity_id", "event_id", "version", F.col("prior_values")["price"].alias("prior_price"), F.col("corrected_values")["price"].alias("corrected_price"))
