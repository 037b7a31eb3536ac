"""Row rules, merges, identity and coverage over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions import keys as KEY
from cutline.functions import numbers as N
from cutline.functions import rows as RW
from cutline.functions import text as TX
from cutline.functions import times
from cutline.operators import context as CX
from cutline.operators import identity as ID
from cutline.operators import merges as MG
from cutline.operators import quality as Q
from cutline.session import checkpoint_dir, materialize
from cutline.sources import readers as SR
from cutline.workload import sql as S
from cutline.workload import tables as T
from cutline.workload.catalog import query, rnd

_ROLE = "case l_returnflag when 'A' then 'RB' when 'R' then 'QB' else 'WR' end"


@query(f"""
with x as (select *, {_ROLE} as position, l_discount > 0 as ran, l_tax > 0 as targeted, l_quantity > 25 as threw from lineitem),
y as (select *, ran or (position in ('RB', 'FB') and targeted) as rush, targeted or (position in ('RB', 'FB', 'WR', 'TE') and ran) as rec from x)
select position, count(case when threw then l_extendedprice end) as passing_lines, count(case when rush then l_extendedprice end) as rushing_lines,
       count(case when rec then l_extendedprice end) as receiving_lines, {S.rnd("sum(case when rec then l_quantity end)", 1)} as receiving_total
from y group by 1""")
def null_vs_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unplayed phases are absent; played ones keep their zeros."""
    items = T.table(spark, sf_dir, "lineitem")
    role = F.when(F.col("l_returnflag") == "A", "RB").when(F.col("l_returnflag") == "R", "QB").otherwise("WR")
    played = RW.participation(F.when(F.col("l_quantity") > 25, 1).otherwise(0), F.col("l_discount"), F.col("l_tax"), role)
    rows = items.select(role.alias("position"), F.col("l_extendedprice"), F.col("l_quantity"), *[c.alias(n) for n, c in played.items()])
    counted = lambda n: F.count(F.when(F.col(n), F.col("l_extendedprice"))).alias(f"{n}_lines")
    total = F.sum(F.when(F.col("receiving"), F.col("l_quantity").cast("decimal(18,2)")))
    return rows.groupBy("position").agg(counted("passing"), counted("rushing"), counted("receiving"), rnd(total, 1, "receiving_total"))


@query(f"""
select o_orderkey, {S.published("o_orderdate + to_hours((o_orderkey % 24)::int)")} as published_at,
  ((o_orderdate + to_minutes((o_orderkey % 1440)::int)) at time zone 'America/New_York') at time zone 'UTC' - repeated_hour as kickoff_utc,
  make_timestamp(year(o_orderdate), 8, 1, 12, 0, 0) as season_release, o_orderdate - interval '5 days' as postseason_release,
  case when year(o_orderdate) >= 1998 then o_orderdate - interval '12 hours' else o_orderdate - interval '24 hours' end as weather_known_at
from (select *, case when o_orderdate in (timestamp '1995-10-29', timestamp '1996-10-27', timestamp '1997-10-26', timestamp '1998-10-25', timestamp '1999-10-31', timestamp '2000-10-29')
  and (o_orderkey % 1440) // 60 = 1 then interval '1 hour' else interval '0 hours' end as repeated_hour from orders)""")
def clock_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication, kickoff parsing and availability bounds, across DST changes.

    A wall-clock hour that occurs twice is read as its first occurrence.
    """
    o = T.table(spark, sf_dir, "orders")
    minute = F.col("o_orderkey") % 1440
    clock = F.concat(F.lpad(F.floor(minute / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minute % 60).cast("string"), 2, "0"))
    era = F.when(F.year("o_orderdate") >= 1998, "archived_forecast").otherwise("reanalysis")
    return o.select(
        "o_orderkey", times.published_at(F.col("o_orderdate") + T.hours((F.col("o_orderkey") % 24).cast("int"))).alias("published_at"),
        times.eastern_to_utc(F.date_format("o_orderdate", "yyyy-MM-dd"), clock).alias("kickoff_utc"),
        times.season_release(F.year("o_orderdate")).alias("season_release"), times.postseason_release(F.col("o_orderdate")).alias("postseason_release"),
        times.weather_known_at(F.col("o_orderdate"), era).alias("weather_known_at"),
    )


@query(f"""
select p_partkey, round_even((p_retailprice / 7)::decimal(38, 14), 1)::double as fixed, trunc(p_retailprice / 7)::bigint as truncated,
       {S.rnd("floor(p_retailprice / 7 * 100 + 0.5) / 100", 3)} as half_up,
       case when floor(p_retailprice / 10 + 0.5) between 1 and 99 then floor(p_retailprice / 10 + 0.5)::int end as cents,
       case when p_type = 'SMALL' then 'REG' when p_type = 'ECONOMY' then 'PRE' else 'POST' end as season_type,
       case when p_size > 25 then 'dome' when p_size > 20 then 'unavailable' when p_size % 3 = 0 then 'request_failed' else 'observed' end as weather_status
from part""")
def row_coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal, integer, half-up, book-side, type and weather rules per part."""
    p = T.table(spark, sf_dir, "part")
    seventh = F.col("p_retailprice") / 7
    kind = F.when(F.col("p_type") == "SMALL", "REG").when(F.col("p_type") == "ECONOMY", "PRE").otherwise("SB")
    status = RW.weather_status(F.col("p_size") > 25, F.lit(False), F.when(F.col("p_size") <= 20, 1.0), F.when(F.col("p_size") % 3 != 0, "src"))
    return p.select(
        "p_partkey", N.fixed_decimal(seventh, 1).cast("double").alias("fixed"), N.whole(seventh).alias("truncated"),
        rnd(N.half_up_2(seventh), 3, "half_up"), N.book_side(F.col("p_retailprice") / 10).alias("cents"),
        RW.season_type(kind).alias("season_type"), status.alias("weather_status"),
    )


@query("""
select o_orderkey, case when m < 60 then m || 'm' when m < 1440 then (m // 60) || 'h'
  when (m // 60) % 24 > 0 then (m // 1440) || 'd ' || ((m // 60) % 24) || 'h' else (m // 1440) || 'd' end as age
from (select o_orderkey, greatest(0, floor(date_diff('second', o_orderdate, timestamp '1999-01-01 07:30:00') / 60))::bigint as m from orders)""")
def age_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("1999-01-01 07:30:00").cast("timestamp")
    return T.table(spark, sf_dir, "orders").select("o_orderkey", times.age_label(F.col("o_orderdate"), now).alias("age"))


@query("""
with x as (select c_custkey, c_name, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('nflverse:player:' || c_name)) as h from customer)
select c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab89ab89ab89ab', ('0x' || substr(h, 17, 1))::int + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as player_key from x""")
def surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.table(spark, sf_dir, "customer")
    return c.select("c_custkey", KEY.player_key(F.col("c_name")).alias("player_key"))


_PEOPLE = """people as (
  select c_custkey as entity_id, split_part(p.p_name, ' ', 1) || case when c_custkey % 5 = 0 then '''' else '' end || ' ' || split_part(p.p_name, ' ', 2)
         || (c_custkey % 400)::varchar || case when c_custkey % 6 = 0 then ' Jr.' else '' end as full_name
  from customer join part p on p.p_partkey = c_custkey % (select count(*) from part))"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with person-like names, suffixes and namesakes."""
    p = T.table(spark, sf_dir, "part").select(F.col("p_partkey"), F.split("p_name", " ").alias("w"))
    parts = T.table(spark, sf_dir, "part").count()
    c = T.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % parts).alias("p_partkey"))
    joined = c.join(p, "p_partkey")
    quote = F.when(T.every("c_custkey", 5), "'").otherwise("")
    suffix = F.when(T.every("c_custkey", 6), " Jr.").otherwise("")
    return joined.select(
        F.col("c_custkey").alias("entity_id"),
        F.concat(F.col("w")[0], quote, F.lit(" "), F.col("w")[1], (F.col("c_custkey") % 400).cast("string"), suffix).alias("full_name"),
    )


_NAMED = _PEOPLE + """,
asked as (select entity_id as asked_id, case when entity_id % 2 = 0 then upper(substr(full_name, 1, 1)) || '. ' || split_part(full_name, ' ', 2)
                                 else upper(full_name) || case when entity_id % 9 = 0 then ' III' else '' end end as name
          from people),
norm as (select entity_id, regexp_replace(regexp_replace(lower(full_name), '''', '', 'g'), '[.,/-]', ' ', 'g') as n from people),
keyed as (select entity_id, list_filter(string_split_regex(trim(regexp_replace(n, '\\s(jr|sr|ii|iii|iv|v)\\s*$', '')), '\\s+'), lambda t: t <> '') as t from norm),
asked_n as (select asked_id, name, list_filter(string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '''', '', 'g'), '[.,/-]', ' ', 'g'),
           '\\s(jr|sr|ii|iii|iv|v)\\s*$', '')), '\\s+'), lambda t: t <> '') as t from asked),
hits as (select a.asked_id, a.name, k.entity_id from asked_n a left join keyed k on
   case when len(a.t) >= 2 and len(a.t[1]) = 1 then substr(k.t[1], 1, 1) = a.t[1] and k.t[-1] = a.t[-1] else array_to_string(k.t, ' ') = array_to_string(a.t, ' ') end)"""


def asked_names(folk: DataFrame) -> DataFrame:
    """Every person's name as some source writes it: initial and surname, or in capitals with a suffix."""
    name = F.when(
        T.every("entity_id", 2), F.concat(F.upper(F.substring("full_name", 1, 1)), F.lit(". "), F.split("full_name", " ")[1])
    ).otherwise(F.concat(F.upper("full_name"), F.when(T.every("entity_id", 9), " III").otherwise("")))
    return folk.select(F.col("entity_id").alias("asked_id"), name.alias("name"))


@query(f"""
with {_NAMED}
select asked_id, name, case count(entity_id) when 0 then 'unresolved' when 1 then 'resolved' else 'ambiguous' end as status,
       case when count(entity_id) = 1 then max(entity_id) end as entity_id, count(entity_id) as candidate_count
from hits group by 1, 2""")
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every person's full or initial-and-surname name against all people; ties stay ambiguous."""
    folk = people(spark, sf_dir)
    return ID.resolve_names(asked_names(folk), folk).select("asked_id", "name", "status", "entity_id", "candidate_count")


@query(f"""
with {_NAMED}
select distinct name, entity_id from hits where asked_id in (select asked_id from hits group by 1 having count(entity_id) > 1)""")
def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of each ambiguous name that any person goes by, each name once."""
    folk = people(spark, sf_dir)
    return ID.ambiguous_candidates(asked_names(folk).select("name").distinct(), folk).select("name", "entity_id")


@query("""
select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(text)), '[.''’-]', ' ', 'g'), '\\b(jr|sr|ii|iii|iv|v)\\b', '', 'g'), '\\s+', ' ', 'g')) as normal
from documents""")
def market_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accent-stripping name form, over every document's whole text."""
    return T.table(spark, sf_dir, "documents").select("doc_id", TX.market_name(F.col("text")).alias("normal"))


_MARKETS = """markets as (
  select 'T' || p_partkey as ticker, 'KX-' || lpad((p_partkey % 30)::varchar, 2, '0') ||
         (['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC','XXX'])[(p_partkey % 13 + 1)::int] || lpad((p_partkey % 28 + 1)::varchar, 2, '0') ||
         (['SEANE','LALAC','KCDET','NYJNYG','LARSF','GBX','LACLV'])[(p_partkey % 7 + 1)::int] as event_ticker,
         case p_size % 4 when 0 then p_name || ': ' || p_size || '+ receiving yards' when 1 then p_name || ' ' || p_size || '+' when 2 then 'Total: over' else p_type || ' yards' end as title,
         case when p_size % 5 = 0 then p_name || ' ' || (p_size + 1) || '.5+' end as yes_sub_title,
         case when p_size % 6 = 0 then p_size - 0.5::double end as floor_strike,
         (['KXNFLPASSYDS','KXNFLRSHYDS','KXNFLRECYDS','KXNFLREC','KXNFLTD'])[(p_partkey % 5 + 1)::int] as series
  from part)"""


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings synthesised from part names and sizes."""
    p = T.table(spark, sf_dir, "part")
    pick = lambda values, n: F.array(*[F.lit(v) for v in values])[(F.col("p_partkey") % n).cast("int")]
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    months = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC", "XXX"]
    size, name = F.col("p_size"), F.col("p_name")
    return p.select(
        F.concat(F.lit("T"), "p_partkey").alias("ticker"),
        F.concat(F.lit("KX-"), pad(F.col("p_partkey") % 30), pick(months, 13), pad(F.col("p_partkey") % 28 + 1),
                 pick(["SEANE", "LALAC", "KCDET", "NYJNYG", "LARSF", "GBX", "LACLV"], 7)).alias("event_ticker"),
        F.when(size % 4 == 0, F.concat(name, F.lit(": "), size, F.lit("+ receiving yards")))
        .when(size % 4 == 1, F.concat(name, F.lit(" "), size, F.lit("+"))).when(size % 4 == 2, "Total: over")
        .otherwise(F.concat("p_type", F.lit(" yards"))).alias("title"),
        F.when(size % 5 == 0, F.concat(name, F.lit(" "), size + 1, F.lit(".5+"))).alias("yes_sub_title"),
        F.when(size % 6 == 0, size - 0.5).alias("floor_strike"),
        pick(["KXNFLPASSYDS", "KXNFLRSHYDS", "KXNFLRECYDS", "KXNFLREC", "KXNFLTD"], 5).alias("series"),
    )


_PARSED = _MARKETS + """,
codes as (select unnest(['ARI','ATL','BAL','BUF','CAR','CHI','CIN','CLE','DAL','DEN','DET','GB','HOU','IND','JAX','KC','LA','LAC','LV','MIA','MIN','NE','NO','NYG','NYJ','PHI',
  'PIT','SEA','SF','TB','TEN','WAS','LAR','WSH','JAC','OAK','SD','STL']) as code),
tails as (select ticker, regexp_extract(event_ticker, '-(\\d{2})([A-Z]{3})(\\d{2})([A-Z]+)$', 4) as teams from markets),
splits as (select t.ticker, substr(t.teams, 1, i) as away, substr(t.teams, i + 1) as home from tails t cross join (values (2), (3)) v(i)
           where length(t.teams) >= i + 2),
valid as (select ticker, count(*) as n, max(away) as away, max(home) as home from splits
          where away in (select code from codes) and home in (select code from codes) group by 1),
parsed as (
  select m.*, case when v.n = 1 then v.away end as away_code, case when v.n = 1 then v.home end as home_code,
    try_strptime('20' || substr(event_ticker, 4, 2) || substr(event_ticker, 6, 5), '%Y%b%d')::date as game_date,
    case series when 'KXNFLPASSYDS' then 'passing_yards' when 'KXNFLRSHYDS' then 'rushing_yards' when 'KXNFLRECYDS' then 'receiving_yards' when 'KXNFLREC' then 'receptions' end as stat_type,
    coalesce(floor_strike, nullif(regexp_extract(yes_sub_title, '(\\d+(\\.\\d+)?)\\s*\\+', 1), '')::double, nullif(regexp_extract(title, '(\\d+(\\.\\d+)?)\\s*\\+', 1), '')::double) as threshold,
    case when yes_sub_title is not null or p_named then p_name end as player_name
  from (select m.*, p.p_name, p_size % 4 in (0, 1) as p_named from markets m join part p on 'T' || p.p_partkey = m.ticker) m left join valid v using (ticker))"""


@query(f"with {_PARSED} select ticker, player_name, stat_type, threshold, game_date, away_code, home_code from parsed")
def market_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing parsed: player, stat, threshold, date and team codes."""
    return ID.parse_markets(markets(spark, sf_dir)).select("ticker", "player_name", "stat_type", "threshold", "game_date", "away_code", "home_code")


def listing_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Parsed listings, the events and people they may name, and stored mappings."""
    parts = T.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n = parts.count()
    words, key = F.split("p_name", " "), F.col("c_custkey")
    folk = T.table(spark, sf_dir, "customer").select("c_custkey", (key % (2 * n // 3)).alias("p_partkey")).join(parts, "p_partkey").select(
        key.alias("entity_id"),
        F.when(~T.every("c_custkey", 50), F.concat(words[0], F.when(T.every("c_custkey", 5), "'").otherwise(""), F.lit(" "), words[1],
                                                   F.when(T.every("c_custkey", 6), " Jr.").otherwise(""))).alias("full_name"))
    parsed = materialize(ID.parse_markets(markets(spark, sf_dir).repartition("ticker")), "parsed")
    dated = parsed.select(F.substring("ticker", 2, 20).cast("long").alias("k"), "game_date", TX.canonical_team(F.col("away_code")).alias("away_team"), TX.canonical_team(F.col("home_code")).alias("home_team"))
    games = dated.dropna().where(~T.every("k", 3)).groupBy("game_date", "away_team", "home_team").agg(F.min("k").alias("event_id")).select(
        "event_id", (F.col("game_date").cast("timestamp") + T.hours(20)).alias("kickoff_at"), "away_team", "home_team")
    status = F.when(T.every("p_partkey", 3), "manual_override").when(T.every("p_partkey", 11), "ambiguous").otherwise("resolved")
    at = lambda c: F.timestamp_seconds(c)
    mappings = parts.where(T.every("p_partkey", 7)).select(F.col("p_name").alias("external_name"), (F.col("p_partkey") + 5000000).alias("entity_id"), status.alias("status"), at(F.col("p_partkey")).alias("updated_at"))
    empty = parts.where(T.every("p_partkey", 14)).select(F.col("p_name").alias("external_name"), F.lit(None).cast("long").alias("entity_id"), F.lit("resolved").alias("status"), at(F.col("p_partkey") + 1000000).alias("updated_at"))
    return parsed, games, folk, mappings.unionByName(empty)


_LISTED = """folk as (select c_custkey as entity_id, case when c_custkey % 50 <> 0 then split_part(p_name, ' ', 1) || case when c_custkey % 5 = 0 then '''' else '' end || ' ' || split_part(p_name, ' ', 2)
                || case when c_custkey % 6 = 0 then ' Jr.' else '' end end as full_name from customer join part on p_partkey = c_custkey % (2 * (select count(*) from part) // 3)),
counts as (select replace(replace(full_name, '''', ''), ' Jr.', '') as full_name, count(*) as n, min(entity_id) as one from folk where full_name is not null group by 1),
mapped as (
  select p_name as external_name, arg_max({'id': id, 'status': status}, (status = 'manual_override', noted)) as m from (
    select p_name, p_partkey + 5000000 as id, case when p_partkey % 3 = 0 then 'manual_override' when p_partkey % 11 = 0 then 'ambiguous' else 'resolved' end as status, p_partkey as noted from part where p_partkey % 7 = 0
    union all select p_name, null, 'resolved', p_partkey + 1000000 from part where p_partkey % 14 = 0)
  where status in ('resolved', 'manual_override') and id is not null group by 1),
canon as (select *, case away_code when 'LAR' then 'LA' else away_code end as a, home_code as h from parsed),
games as (select min(substr(ticker, 2)::bigint) as event_id, game_date + interval '20 hours' as kickoff_at, a as away_team, h as home_team from canon
          where substr(ticker, 2)::bigint % 3 <> 0 and game_date is not null and a is not null and h is not null group by game_date, a, h),
dated as (select c.*, (select arg_min(g.event_id, (g.kickoff_at, g.event_id)) from games g where g.away_team = c.a and g.home_team = c.h
          and g.kickoff_at >= c.game_date and g.kickoff_at < c.game_date + interval '2 days') as event_id from canon c),
judged as (
  select d.*, coalesce(k.n, 0) as n, m.m.id as mapped_id, coalesce(m.m.id, case when k.n = 1 then k.one end) as entity_id,
         coalesce(m.m.status, case when k.n = 1 then 'resolved' when k.n > 1 then 'ambiguous' else 'unresolved' end) as person
  from dated d left join counts k on k.full_name = d.player_name left join mapped m on m.external_name = d.player_name)"""
_JUDGED = """
select ticker, series, stat_type, threshold, entity_id, event_id,
  case when entity_id is not null and event_id is not null and stat_type is not null and threshold is not null then case when person = 'manual_override' then 'manual_override' else 'resolved' end
       when person = 'ambiguous' then 'ambiguous' else 'unresolved' end as resolution_status,
  nullif(concat_ws('; ', case when stat_type is null then 'stat: series ' || series || ' has none' end, case when threshold is null then 'threshold: none given' end,
         case when game_date is null or away_code is null or home_code is null then 'event: no date and teams in ' || event_ticker
              when event_id is null then 'event: none of ' || a || ' at ' || h || ' near ' || game_date::varchar end,
         case when player_name is null then 'player: none named' when mapped_id is null and n <> 1 then 'player: ' || n || ' are called ' || player_name end), '') as resolution_note
from judged"""


@query(f"with {_PARSED}, {_LISTED} select ticker, entity_id, event_id, resolution_status, resolution_note from ({_JUDGED})")
def contract_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings to entity and event, by stored mappings first, then by name among all people; what fails is named, never guessed."""
    out = ID.resolve_contracts(*listing_sides(spark, sf_dir))
    return out.select("ticker", "entity_id", "event_id", "resolution_status", "resolution_note")


_SEEN = """
ticks as (select unnest([0, 1, 2]) as tick), 
seen as (select p_partkey as k, tick, timestamp '2007-03-01 12:00:00' + to_minutes((tick * 5)::int) as at_,
                p_size * 2 - 1 + case when tick > 0 and p_partkey % 4 = 1 then 1 when tick > 1 and p_partkey % 4 = 2 then 2 else 0 end as ask
         from part cross join ticks where p_partkey % 5 <> (case tick when 0 then 0 when 1 then 1 else 2 end)),
priced as (select *, case when ask between 1 and 99 then ask end as yes_ask, case when ask - 2 between 1 and 99 then ask - 2 end as yes_bid from seen),
books as (select *, lag(struct_pack(a := yes_ask, b := yes_bid)) over (partition by k order by tick) as before, row_number() over (partition by k order by tick) as nth from priced)"""


def market_store(spark: SparkSession, sf_dir: str):
    """Three ticks over all listings: each leaves out a fifth, the second also failed in part; it is written twice, first without its marker."""
    from cutline.plans import market_sync as MS

    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _STORES:
        return _STORES[key]
    store = MS.MarketStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/market-{uuid.uuid4().hex}")
    _, *sides = listing_sides(spark, sf_dir)
    games, folk, mappings = (materialize(side, name) for side, name in zip(sides, ("games", "people", "mappings")))  # what every tick reads
    size = T.table(spark, sf_dir, "part").select(F.concat(F.lit("T"), "p_partkey").alias("ticker"), "p_partkey", "p_size")
    listed = materialize(markets(spark, sf_dir).join(size, "ticker"), "listed")
    for n, left_out in enumerate((0, 1, 2)):
        moved = F.when((F.col("p_partkey") % 4 == 1) & F.lit(n > 0), 1).when((F.col("p_partkey") % 4 == 2) & F.lit(n > 1), 2).otherwise(0)
        ask = (F.col("p_size") * 2 - 1 + moved).cast("double")
        found = listed.where(F.col("p_partkey") % 5 != left_out).select("*", (ask - 2).alias("yes_bid"), ask.alias("yes_ask"), (100 - ask).alias("no_bid"), (102 - ask).alias("no_ask"),
                                                                        F.lit(None).cast("string").alias("close_time")).drop("p_partkey", "p_size")
        failures = spark.range(1 if n == 1 else 0).select(F.lit("series").alias("what"))
        at = F.lit("2007-03-01 12:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(5 * n))
        if n == 1:  # a tick that stopped before its marker
            found.select(F.lit("X").alias("ticker"), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in MS.OBSERVATION.split(", ")[1:]]).write.mode("overwrite").parquet(f"{store.root}/observations/tick=1")
        store.tick(n, found, failures, games, folk, at, mappings)
    _STORES[key] = store
    return store


_STORES: dict = {}


@query(f"""
with {_PARSED}, {_LISTED}, {_SEEN},
spans as (select k, min(at_) as first_seen_at, max(at_) as last_seen_at, max(tick) as last_tick from seen group by 1)
select j.ticker, j.series, j.entity_id, j.event_id, j.stat_type, j.threshold, j.resolution_status, j.resolution_note, case when s.last_tick < 2 then 'delisted' else 'active' end as status, s.first_seen_at, s.last_seen_at
from ({_JUDGED}) j join spans s on 'T' || s.k = j.ticker""")
def market_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole contract rows after three ticks, one of them partial: only the complete one delists."""
    return market_store(spark, sf_dir).contracts().drop("close_time")


@query(f"""
with {_SEEN[1:]}
select 'T' || k as ticker, tick, at_ as observed_at, yes_bid, yes_ask from books where nth = 1 or before.a is distinct from yes_ask or before.b is distinct from yes_bid""")
def market_tick_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The books that three ticks recorded: new ones and changed ones."""
    return market_store(spark, sf_dir).rows("observations").select("ticker", "tick", "observed_at", "yes_bid", "yes_ask")


@query("select tick, (tick = 1)::bigint as failures, (select count(*) from part where p_partkey % 5 <> (case tick when 0 then 0 when 1 then 1 else 2 end)) as discovered, case tick when 1 then 'partial' else 'complete' end as status from (select unnest([0, 1, 2]) as tick)")
def market_tick_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each tick went."""
    return market_store(spark, sf_dir).rows("syncs").select("tick", "failures", "discovered", "status")


_MERGE = """incoming as (select c_custkey as k, c_name as name, case when c_custkey % 10 = 0 then null when c_custkey % 4 = 0 then 'MOVED' else c_mktsegment end as segment
  from customer where c_custkey % 9 <> 0 union all select s_suppkey + 10000000, s_name, 'NEW' from supplier),
current_ as (select c_custkey as k, c_name as name, case when c_custkey % 20 = 0 then null else c_mktsegment end as segment from customer)"""


@query(f"""
with {_MERGE}
select case when c.k is null then 'inserted' when i.k is null then 'kept' when c.segment is distinct from i.segment then 'updated' else 'unchanged' end as action,
       count(*) as rows from current_ c full join incoming i on i.k = c.k group by 1""")
def upsert_if_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, update or leave each row, NULLs compared as values."""
    current, incoming = upsert_sides(spark, sf_dir)
    return MG.upsert_if_distinct(current, incoming, ["k"], ["name", "segment"]).counters()


def upsert_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = T.table(spark, sf_dir, "customer")
    name = [F.col("c_custkey").alias("k"), F.col("c_name").alias("name")]
    moved = F.when(T.every("c_custkey", 10), None).when(T.every("c_custkey", 4), "MOVED").otherwise(F.col("c_mktsegment"))
    fresh = T.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10000000).alias("k"), F.col("s_name").alias("name"), F.lit("NEW").alias("segment"))
    incoming = c.where(~T.every("c_custkey", 9)).select(*name, moved.alias("segment")).unionByName(fresh)
    current = c.select(*name, F.when(~T.every("c_custkey", 20), F.col("c_mktsegment")).alias("segment"))
    return current, incoming


@query(S.with_(S.LINES) + """,
now_ as (select *, case when event_id % 8 = 0 then price + 5 when event_id % 12 = 0 then null else price end as new_price from lines_wide where event_id % 6 <> 1)
select case when n.event_id % 3 = 2 then 'inserted' when n.price is distinct from n.new_price then 'corrected' else 'unchanged' end as action,
       count(*) as rows, sum(case when event_id % 3 <> 2 and price is distinct from new_price then 2 else 1 end)::bigint as versions
from now_ n group by 1
union all select 'kept', count(*), count(*) from lines_wide where event_id % 6 = 1 and event_id % 3 <> 2""")
def correction_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries of the stat lines: new, equal and corrected ones, versioned."""
    merged = two_deliveries(spark, sf_dir)
    joined = merged.actions.join(merged.current.select("entity_id", "event_id", "version"), ["entity_id", "event_id"])
    return joined.groupBy("action").agg(F.count("*").alias("rows"), F.sum(F.col("version").cast("long")).alias("versions"))


def two_deliveries(spark: SparkSession, sf_dir: str) -> MG.Merge:
    w = T.lines_wide(spark, sf_dir)
    current = w.where(F.col("event_id") % 3 != 2).withColumns({"version": F.lit(1), "known_at": F.col("published_at")})
    changed = F.when(T.every("event_id", 8), F.col("price") + 5).when(T.every("event_id", 12), None).otherwise(F.col("price"))
    incoming = w.where(F.col("event_id") % 6 != 1).withColumn("price", changed)
    return MG.correction_merge(current, incoming, ["price", "lines"], F.lit("2002-01-01").cast("timestamp"))


@query(S.with_(S.ORDERS) + """,
cur as (select event_id, season, valid_at as kickoff_at, 'hall' as venue, 'scheduled' as status from order_events where event_id % 4 <> 3),
inc as (select event_id, season, case when event_id % 25 = 0 then null when event_id % 10 = 0 then valid_at + interval '1 hour' else valid_at end as kickoff_at,
        case when event_id % 15 = 0 then 'park' else 'hall' end as venue, case when o_orderstatus = 'F' then 'completed' else 'scheduled' end as status from order_events)
select i.event_id, i.kickoff_at, i.venue, case when c.event_id is null then 'scheduled' else i.status end as status,
       case when c.event_id is not null then timestamp '2002-01-01 00:00:00' when i.season % 2 = 0 then i.kickoff_at - interval '5 days'
            else make_timestamp(i.season, 8, 1, 12, 0, 0) end as known_at
from inc i left join cur c on c.event_id = i.event_id
where i.kickoff_at is not null and (c.event_id is null or i.kickoff_at is distinct from c.kickoff_at or i.venue is distinct from c.venue or i.status is distinct from c.status)""")
def schedule_revision_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisions a second schedule delivery appends."""
    o = T.orders(spark, sf_dir)
    kind = F.when(F.col("season") % 2 == 0, "POST").otherwise("REG")
    sides = [kind.alias("season_type"), F.lit("H").alias("home_team"), F.lit("A").alias("away_team")]
    cur = o.where(F.col("event_id") % 4 != 3).select("event_id", "season", *sides, F.col("valid_at").alias("kickoff_at"), F.lit("hall").alias("venue"), F.lit("scheduled").alias("status"))
    kick = F.when(T.every("event_id", 25), None).when(T.every("event_id", 10), F.col("valid_at") + T.hours(1)).otherwise(F.col("valid_at"))
    inc = o.select("event_id", "season", *sides, kick.alias("kickoff_at"), F.when(T.every("event_id", 15), "park").otherwise("hall").alias("venue"),
                   F.when(F.col("o_orderstatus") == "F", "completed").otherwise("scheduled").alias("status"))
    return MG.schedule_merge(cur, inc, F.lit("2002-01-01").cast("timestamp")).log.drop("known_at_reconstructed")


@query("""
select l_orderkey, l_linenumber, min(l_partkey) as l_partkey from lineitem
where (l_orderkey, l_linenumber) not in (select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R') group by 1, 2""")
def append_if_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys neither stored nor repeated within the batch, first part kept."""
    items = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    key = ["l_orderkey", "l_linenumber"]
    stored = items.where(F.col("l_returnflag") == "R").select(*key, "l_partkey")
    return MG.append_if_new(stored, items.select(*key, "l_partkey"), key, ["l_partkey"]).log


@query("""
select l_orderkey, l_linenumber, arg_max(l_partkey, (l_shipdate, l_partkey, l_suppkey, l_extendedprice)) as l_partkey, count(*) - 1 as collapsed
from lineitem group by 1, 2""")
def last_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last row per key by an explicit sequence, and how many it folded."""
    items = T.table(spark, sf_dir, "lineitem")
    key = ["l_orderkey", "l_linenumber"]
    seq = items.withColumn("seq", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")).select(*key, "l_partkey", "seq")
    kept = MG.last_wins(seq, key, "seq").select(*key, "l_partkey")
    return kept.join(items.groupBy(*key).agg((F.count("*") - 1).alias("collapsed")), key)


@query(f"""
with t as (unpivot (select l_orderkey, l_linenumber, l_partkey, round_even(l_quantity::decimal(18, 4), 0)::double as qty, round_even(l_discount::decimal(18, 6), 3)::double as discount, nullif(l_tax, 0) as tax from lineitem)
  on qty, discount, tax into name context_type value numeric_value)
select context_type, count(*) as rows, {S.rnd("sum(numeric_value)", 3)} as total from t group by 1""")
def observation_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measure columns to tall observations; absent ones make no row."""
    items = T.table(spark, sf_dir, "lineitem").withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    tall = CX.unpivot(items, ["l_orderkey"], (("qty", "l_quantity", 0), ("discount", "l_discount", 3), ("tax", "l_tax", 3)))
    return tall.groupBy("context_type").agg(F.count("*").alias("rows"), rnd(F.sum("numeric_value"), 3, "total"))


@query("""
select case when o.o_orderkey is null then 'unknown_event' when p.p_partkey is null then 'unknown_entity' else 'loaded' end as outcome, count(*) as rows
from lineitem l left join (select o_orderkey from orders where o_orderstatus <> 'P') o on o.o_orderkey = l.l_orderkey
left join (select p_partkey from part where p_size <> 7) p on p.p_partkey = l.l_partkey group by 1""")
def skip_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an unknown parent are skipped and counted, by reason."""
    rows = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("entity_id"))
    events = T.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("event_id"))
    entities = T.table(spark, sf_dir, "part").where(F.col("p_size") != 7).select(F.col("p_partkey").alias("entity_id"))
    return CX.skip_report(CX.with_known_parents(rows, entities, events))


@query("""
with facts as (select distinct 'stats' as dataset, year(o_orderdate)::int as season from orders union select distinct 'schedule', year(l_shipdate)::int from lineitem)
select dataset, season from facts where not (dataset = 'stats' and season = 1996)""")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons with facts, less the ledger's vetoes."""
    facts = {"stats": T.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("season")),
             "schedule": T.table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("season"))}
    ledger = spark.createDataFrame([("stats", 1996, "none"), ("schedule", 1999, "full")], "dataset string, season int, coverage string")
    return SR.covered_seasons(facts, ledger)


@query("""
select r.season, case when p.season is null then 'none' else 'full' end as coverage, case when p.season is null then 'no orders coverage upstream for ' || r.season end as note
from (select unnest(range(1993, 2004))::int as season) r left join (select distinct year(o_orderdate)::int as season from orders) p using (season)""")
def coverage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = T.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("season"))
    return SR.coverage_ledger("landed", "orders", SR.season_range(1993, 2003), facts).select("season", "coverage", "note")


@query("""
with v as (select count(case when l_shipdate < o_orderdate then 1 end) as a, count(case when l_discount not between 0 and 1 then 1 end) as b
           from lineitem join orders on o_orderkey = l_orderkey)
select 'known_after_valid' as rule, a as violations from v union all select 'discount_bounds', b from v
union all select 'unique_line', sum(n - 1)::bigint from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)
union all select 'status_set', count(*) from orders where o_orderstatus not in ('F', 'O')""")
def dq_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal, bound, uniqueness and enum rules, counted."""
    items = T.table(spark, sf_dir, "lineitem")
    o = T.table(spark, sf_dir, "orders")
    both = items.join(o, F.col("o_orderkey") == F.col("l_orderkey")).withColumns({"known_at": F.col("l_shipdate"), "valid_at": F.col("o_orderdate")})
    rules = {"known_after_valid": Q.known_after_valid(), "discount_bounds": F.col("l_discount").between(0, 1)}
    return (
        Q.violations(both, rules).unionByName(Q.duplicate_keys(items, ["l_orderkey", "l_linenumber"], "unique_line"))
        .unionByName(Q.not_in_set(o, "o_orderstatus", ["F", "O"], "status_set"))
    )


@query("""
select n_nationkey, n_name, r_name, sides from nation join region on r_regionkey = n_regionkey
join (select n_regionkey as k, count(*) * 2 as sides from nation group by 1) s on s.k = n_regionkey""")
def two_sided_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events unpivoted to one row per side, read back through dimensions."""
    n = T.table(spark, sf_dir, "nation")
    games = n.select(F.col("n_regionkey").alias("season"), F.lit(1).alias("week"), F.col("n_name").alias("home_team"), F.concat(F.lit("A"), "n_name").alias("away_team"),
                     F.col("n_nationkey").alias("event_id"), F.lit(None).cast("timestamp").alias("kickoff_at"))
    sides = CX.events_by_side(games).groupBy(F.col("season").alias("n_regionkey")).agg(F.count("*").alias("sides"))
    r = T.table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).join(sides, "n_regionkey").select("n_nationkey", "n_name", "r_name", "sides")
