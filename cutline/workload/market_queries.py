"""Prices, slate, staleness, snapshots, decisions and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline import constants as K
from cutline.functions import market as M
from cutline.functions import numbers as N
from cutline.operators import market as MK
from cutline.operators import merges as MG
from cutline.operators import runs as R
from cutline.plans import live as LV
from cutline.workload import sql as S
from cutline.workload import tables as T
from cutline.workload.catalog import query, rnd
from cutline.workload.model_queries import RUN, stored_run

NOW = "1999-07-01 00:00:00"
HEARTBEAT_MINUTES = 720

_BOOK = """book as (
  select event_id as observation_id, user_id as contract_id, ts as observed_at, a as yes_ask, case when a - 2 between 1 and 99 then a - 2 end as yes_bid,
         case when 100 - a between 1 and 99 then 100 - a end as no_bid,
         case when a - 2 between 1 and 99 then 100 - (a - 2) end as no_ask
  from (select *, case when floor(value + 0.5) between 1 and 99 then floor(value + 0.5)::int end as a from events))"""


@query(f"with {_BOOK} select contract_id, arg_max(observation_id, (observed_at, observation_id)) as observation_id, count(*) as observations from book group by 1")
def latest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest book per contract by a partial aggregate."""
    book = T.price_book(spark, sf_dir)
    counts = book.groupBy("contract_id").agg(F.count("*").alias("observations"))
    return MK.latest_prices(book).select("contract_id", "observation_id").join(counts, "contract_id")


@query(f"""
with {_BOOK} select observation_id, contract_id, case when yes_bid is not null and yes_ask is not null then floor((yes_bid + yes_ask) / 2.0 + 0.5)::int end as mid,
  lag(observation_id) over w is null or yes_bid is distinct from lag(yes_bid) over w or yes_ask is distinct from lag(yes_ask) over w
  or no_bid is distinct from lag(no_bid) over w or no_ask is distinct from lag(no_ask) over w as changed
from book window w as (partition by contract_id order by observed_at, observation_id)""")
def price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change detection on any side, NULL-safe."""
    out = MK.with_changes(T.price_book(spark, sf_dir), bucket_seconds=86400)
    return out.select("observation_id", "contract_id", N.mid_price(F.col("yes_bid"), F.col("yes_ask")).alias("mid"), "changed")


# Coarse books, so that long runs of equal books occur.
_COARSE = """coarse as (
  select event_id as observation_id, user_id as contract_id, ts as observed_at, (floor(value / 200) * 20 + 5)::int as yes_ask from events),
seq as (select *, row_number() over (partition by contract_id order by observed_at, observation_id) as rn from coarse)"""
COMPACTION = f"""
with recursive {_COARSE},
walk as (
  select contract_id, rn, observation_id, yes_ask as kept_ask, observed_at as kept_at, true as emitted from seq where rn = 1
  union all
  select s.contract_id, s.rn, s.observation_id,
         case when s.yes_ask <> w.kept_ask or s.observed_at >= w.kept_at + interval '720 minutes' then s.yes_ask else w.kept_ask end,
         case when s.yes_ask <> w.kept_ask or s.observed_at >= w.kept_at + interval '720 minutes' then s.observed_at else w.kept_at end,
         s.yes_ask <> w.kept_ask or s.observed_at >= w.kept_at + interval '720 minutes'
  from walk w join seq s on s.contract_id = w.contract_id and s.rn = w.rn + 1)
select contract_id, observation_id from walk where emitted"""


def coarse_book(events: DataFrame) -> DataFrame:
    ask = (F.floor(F.col("value") / 200) * 20 + 5).cast("int")
    return events.select(
        F.col("event_id").alias("observation_id"), F.col("user_id").alias("contract_id"), F.col("ts").alias("observed_at"),
        (ask - 2).alias("yes_bid"), ask.alias("yes_ask"), (100 - ask).alias("no_bid"), (102 - ask).alias("no_ask"),
    )


@query(COMPACTION)
def price_change_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change-or-heartbeat recorder would have kept of the whole history."""
    kept = MK.compact_prices(coarse_book(T.table(spark, sf_dir, "events")), HEARTBEAT_MINUTES, bucket_seconds=7 * 86400)
    return kept.select("contract_id", "observation_id")


_STATES = """states as (
  select user_id as contract_id, ts as "at", event_id as seq, value > 60 as is_recommended, case when event_id % 3 = 0 then 'no' when event_id % 7 = 0 then null else 'yes' end as side from events)"""
TRANSITIONS = f"""
with {_STATES},
x as (select *, lag(is_recommended) over w as prec, lag(side) over w as pside,
       coalesce(max(is_recommended::int) over (partition by contract_id order by "at", seq rows between unbounded preceding and 1 preceding), 0) as seen
      from states window w as (partition by contract_id order by "at", seq))
select contract_id, seq, is_recommended, side, case when seen = 0 then 'appeared' else 'state_changed' end as trigger
from x where (seen = 0 and is_recommended) or (seen = 1 and (is_recommended <> prec or (is_recommended and side is distinct from pside)))"""


def slate_states(events: DataFrame) -> DataFrame:
    side = F.when(T.every("event_id", 3), "no").when(~T.every("event_id", 7), "yes")
    return events.select(F.col("user_id").alias("contract_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
                         (F.col("value") > 60).alias("is_recommended"), side.alias("side"))


@query(TRANSITIONS)
def recommendation_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appearances and state changes over the whole history."""
    out = MK.transitions(slate_states(T.table(spark, sf_dir, "events")), bucket_seconds=7 * 86400)
    return out.select("contract_id", "seq", "is_recommended", "side", "trigger")


@query("""
with d as (select event_id as decision_id, user_id as contract_id, event_type as disposition, ts as decided_at from events),
c as (select *, lag(disposition) over (partition by contract_id order by decided_at, decision_id) as prev, row_number() over (partition by contract_id order by decided_at, decision_id) as rn from d)
select decision_id, contract_id, disposition, lag(decision_id) over (partition by contract_id order by decided_at, decision_id) as supersedes_decision_id
from c where rn = 1 or disposition is distinct from prev""")
def decision_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats write nothing; each recorded decision links the one it replaces."""
    e = T.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("decision_id"), F.col("user_id").alias("contract_id"), F.col("event_type").alias("disposition"), F.col("ts").alias("decided_at")
    )
    return MK.supersede(e, bucket_seconds=7 * 86400).drop("decided_at")


_ASKED = f"""
asked as (
  select o.event_id * 4 + k as decision_id, case when o.event_id % 97 = 0 then -o.event_id - 1 else o.event_id end as contract_id,
         case when ((o.event_id + k) // 2) % 2 = 0 then 'take' else 'pass' end as disposition,
         o.valid_at - to_hours(((3 - k) * 12)::int) - interval '30 minutes' + case when o.event_id % 10 = 0 then interval '5 days' else interval '0 days' end as decided_at
  from order_events o cross join (values (1), (2), (3)) v(k)),
kept as (select -event_id - 1 as decision_id, event_id as contract_id, 'take' as disposition, valid_at - interval '30 days' as decided_at from order_events where event_id % 5 = 0),
listed as (
  select event_id as contract_id, entity_id, case when event_id % 31 <> 0 then event_id end as event_id, 24.5::double + 50 * (event_id % 9) as threshold,
         case when event_id % 23 = 0 then 'delisted' else 'active' end as status, case when event_id % 62 = 0 then valid_at - interval '20 hours' end as close_time from order_events),
judged as (
  select a.*, l.entity_id, l.event_id, l.threshold,
         case when l.contract_id is null then 'no_such_contract'
              when e.event_id is not null and (e.valid_at <= a.decided_at or e.o_orderstatus = 'F') then 'event_closed'
              when e.event_id is null and (l.status <> 'active' or coalesce(l.close_time <= a.decided_at, false)) then 'market_closed' end as refusal
  from asked a left join listed l using (contract_id) left join order_events e on e.event_id = l.event_id),
chain as (
  select *, lag(decision_id) over (partition by contract_id order by decided_at, decision_id) as supersedes_decision_id from (
    select *, lag(disposition) over w as before, row_number() over w as nth
    from (select decision_id, contract_id, disposition, decided_at from judged where refusal is null union all select * from kept) window w as (partition by contract_id order by decided_at, decision_id))
  where nth = 1 or before is distinct from disposition),
taken as (select j.*, c.supersedes_decision_id from judged j join chain c using (decision_id)),
books as (
  select l_orderkey as contract_id, case when floor(l_quantity * 2 + 0.5) between 1 and 99 then floor(l_quantity * 2 + 0.5)::int end as yes_ask,
         l_shipdate - interval '100 days' + to_hours(l_linenumber) as observed_at, (l_partkey * 10000 + l_suppkey) * 100 + l_quantity::bigint as observation_id from lineitem),
book as (select t.decision_id, arg_max({{'id': b.observation_id, 'ask': b.yes_ask}}, (b.observed_at, b.observation_id)) as q
         from taken t join books b on b.contract_id = t.contract_id and b.observed_at <= t.decided_at group by 1),
models as (
  select target_id as projection_id, entity_id, event_id, cutoff as computed_at, confidence, p_zero, mu, sigma, projected_value from outcomes where measure = 'price' and projected_value is not null
  union all select 'old:' || target_id, entity_id, event_id, cutoff - interval '1 day', 'low', null, null, null, null from outcomes where measure = 'price' and projected_value is not null),
model as (select t.decision_id, arg_max({{'id': m.projection_id, 'c': m.confidence, 'p_zero': m.p_zero, 'mu': m.mu, 'sigma': m.sigma, 'value': m.projected_value}}, (m.computed_at, m.projection_id)) as m
          from taken t join models m on m.entity_id = t.entity_id and m.event_id = t.event_id and m.computed_at <= t.decided_at group by 1),
flat as (
  select t.*, b.q.id as observation_id, b.q.ask as yes_ask, case when b.q.ask - 2 between 1 and 99 then 100 - (b.q.ask - 2) end as no_ask, m.m.id as projection_id, m.m.c as confidence,
         m.m.p_zero as p_zero, m.m.mu as mu, m.m.sigma as sigma, m.m.value as model_value
  from taken t left join book b using (decision_id) left join model m using (decision_id)),
priced as (select *, case when model_value is not null then {S.zil_at_least("threshold")} end as model_probability from flat),
edged as (select *, case when confidence is not null then model_probability * 100 - yes_ask end as ye, case when confidence is not null then (1 - model_probability) * 100 - no_ask end as ne from priced),
best as (select *, greatest(ye, ne) as b, case when ye is not null and (ne is null or ye >= ne) then 'yes' when ne is not null then 'no' end as side from edged)"""


@query(S.with_(*RUN) + f""", {_ASKED}
select j.decision_id, j.contract_id, j.disposition, j.decided_at, coalesce(j.refusal, case when b.decision_id is not null then 'recorded' else 'unchanged' end) as outcome,
       b.supersedes_decision_id, b.projection_id, b.observation_id, {S.rnd('b.model_probability', 6)} as model_probability, b.side,
       case b.side when 'yes' then b.yes_ask when 'no' then b.no_ask end as ask_cents, {S.rnd('floor(b.b * 100 + 0.5) / 100', 1)} as edge_points, b.confidence,
       case when b.decision_id is not null then coalesce(floor(b.b * case b.confidence when 'high' then 1.0 when 'medium' then 0.7 else 0.4 end::double * 100 + 0.5) / 100 >= 5, false) end as is_recommended
from judged j left join best b using (decision_id)""")
def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests a contract beside stored decisions: recorded with their frozen inputs, unchanged, or refused."""
    o = T.orders(spark, sf_dir)
    key = F.col("event_id")
    late = F.when(T.every("event_id", 10), T.days(5)).otherwise(T.days(0))
    asked = o.select("event_id", "valid_at", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("k")).select(
        (key * 4 + F.col("k")).alias("decision_id"), F.when(T.every("event_id", 97), -key - 1).otherwise(key).alias("contract_id"),
        F.when(F.floor((key + F.col("k")) / 2) % 2 == 0, "take").otherwise("pass").alias("disposition"),
        (F.col("valid_at") - T.hours((3 - F.col("k")) * 12) - F.expr("INTERVAL 30 MINUTES") + late).alias("decided_at"))
    kept = o.where(T.every("event_id", 5)).select((-key - 1).alias("decision_id"), key.alias("contract_id"), F.lit("take").alias("disposition"), (F.col("valid_at") - T.days(30)).alias("decided_at"))
    listed = o.select(key.alias("contract_id"), "entity_id", F.when(~T.every("event_id", 31), key).alias("event_id"), F.lit("price").alias("stat_type"), (24.5 + 50 * (key % 9)).alias("threshold"),
                      F.when(T.every("event_id", 23), "delisted").otherwise("active").alias("status"), F.when(T.every("event_id", 62), F.col("valid_at") - T.hours(20)).alias("close_time"))
    books = quotes(spark, sf_dir).withColumn("observed_at", F.col("observed_at") - T.days(100))
    out = MK.decision_log(asked, listed, games(spark, sf_dir), kept, projections(spark, sf_dir), books)
    return out.select("decision_id", "contract_id", "disposition", "decided_at", "outcome", "supersedes_decision_id", "projection_id", "observation_id",
                      rnd("model_probability", 6), "side", "ask_cents", rnd("edge_points", 1), "confidence", "is_recommended")


_EDGE = """x as (
  select event_id, value / 500.0::double as p, (['high', 'medium', 'low', null])[(event_id % 4 + 1)::int] as confidence,
         case when event_id % 5 > 0 then (event_id % 90 + 5)::int end as yes_ask, case when event_id % 6 > 0 then (event_id % 80 + 10)::int end as no_ask from events),
e as (select *, case when confidence is not null then p * 100 - yes_ask end as ye, case when confidence is not null then (1 - p) * 100 - no_ask end as ne from x),
b as (select *, greatest(ye, ne) as best, case when ye is not null and (ne is null or ye >= ne) then 'yes' when ne is not null then 'no' end as side from e),
r as (select *, floor(best * 100 + 0.5) / 100 as edge_points, floor(best * case confidence when 'high' then 1.0 when 'medium' then 0.7 else 0.4 end::double * 100 + 0.5) / 100 as adjusted_edge from b)"""


@query(f"""
with {_EDGE} select event_id, side, {S.rnd('edge_points', 2)} as edge_points, {S.rnd('adjusted_edge', 2)} as adjusted_edge, coalesce(adjusted_edge >= 5, false) as is_recommended,
  row_number() over (order by adjusted_edge desc nulls last, edge_points desc nulls last, event_id) as slate_rank from r""")
def edge_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge against the better side's ask, and each row's place in the slate."""
    e = T.table(spark, sf_dir, "events")
    labels = F.array(*[F.lit(x) for x in ("high", "medium", "low", None)])
    rows = e.select("event_id", (F.col("value") / 500.0).alias("p"), labels[(F.col("event_id") % 4).cast("int")].alias("confidence"),
                    F.when(~T.every("event_id", 5), (F.col("event_id") % 90 + 5).cast("int")).alias("yes_ask"),
                    F.when(~T.every("event_id", 6), (F.col("event_id") % 80 + 10).cast("int")).alias("no_ask"))
    scored = rows.withColumns(M.edge(F.col("p"), F.col("confidence"), F.col("yes_ask"), F.col("no_ask")))
    ranked = MK.slate_places(scored, ["event_id"])
    return ranked.select("event_id", "side", rnd("edge_points", 2), rnd("adjusted_edge", 2), "is_recommended", "slate_rank")


_FACTS = """fixtures as (select event_id, season, team as home_team, (team + 1) % 25 as away_team, valid_at from lines_wide),
done as (select f.* from fixtures f join order_events o using (event_id) where o.o_orderstatus = 'F'),
facts as (
  select event_id, max(known_at) as latest_fact_known_at from (
    select event_id, known_at from revisions
    union all
    select f.event_id, max(l.published_at) from fixtures f join done d on d.season = f.season and (d.home_team in (f.home_team, f.away_team) or d.away_team in (f.home_team, f.away_team))
    join order_events l on l.event_id = d.event_id group by 1) group by 1)"""


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.lines_wide(spark, sf_dir)
    return w.select("event_id", "season", F.col("team").alias("home_team"), ((F.col("team") + 1) % 25).alias("away_team"), "valid_at")


def latest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures(spark, sf_dir)
    o = T.orders(spark, sf_dir)
    done = f.join(o.where("o_orderstatus = 'F'").select("event_id"), "event_id", "left_semi")
    lines = o.select("event_id", F.col("published_at").alias("known_at"))
    return MK.latest_fact_per_event(f, [T.revisions(spark, sf_dir)], [lines], done)


@query(S.with_(S.LINES, S.CLOCK) + f""", {_FACTS}
select c.event_id, f.latest_fact_known_at, coalesce(f.latest_fact_known_at > c.cutoff, false) as is_stale, timestamp '{NOW}' >= c.valid_at - interval '90 minutes' as predates_inactives
from event_clock c left join facts f using (event_id)""")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest fact per event over shared teams, and both staleness states."""
    now = F.lit(NOW).cast("timestamp")
    rows = T.event_clock(spark, sf_dir).select("event_id", "valid_at", "cutoff").join(latest_facts(spark, sf_dir), "event_id", "left")
    return rows.withColumns(M.staleness(F.col("valid_at"), F.col("cutoff"), F.col("latest_fact_known_at"), now)).select(
        "event_id", "latest_fact_known_at", "is_stale", "predates_inactives"
    )


_SLATE = f"""contracts as (
  select o.event_id as contract_id, 'C' || o.event_id as ticker, o.entity_id, o.event_id, 'price' as stat_type, 24.5::double + 50 * (o.event_id % 9) as threshold,
         case when o.event_id % 23 = 0 then 'delisted' else 'active' end as status,
         case when o.event_id % 41 = 0 then 'unresolved' when o.event_id % 37 = 0 then 'ambiguous' when o.event_id % 8 = 0 then 'manual_override' else 'resolved' end as resolution_status,
         o.valid_at as kickoff_at, o.o_orderstatus from order_events o),
quotes as (
  select l_orderkey as contract_id, case when floor(l_quantity * 2 + 0.5) between 1 and 99 then floor(l_quantity * 2 + 0.5)::int end as yes_ask,
         l_shipdate + to_hours(l_linenumber) as observed_at, (l_partkey * 10000 + l_suppkey) * 100 + l_quantity::bigint as observation_id from lineitem),
latest as (select contract_id, arg_max({{'ask': yes_ask}}, (observed_at, observation_id)) as q from quotes group by 1),
priced as (
  select c.*, l.q.ask as yes_ask, case when l.q.ask - 2 between 1 and 99 then 100 - (l.q.ask - 2) end as no_ask, p.confidence, p.cutoff,
         case when p.projected_value is not null then {S.zil_at_least("threshold")} end as model_probability
  from contracts c left join (select event_id as e, p_zero, mu, sigma, confidence, cutoff, projected_value from outcomes where measure = 'price' and projected_value is not null) p on p.e = c.event_id
  left join latest l using (contract_id)),
edged as (select *, case when confidence is not null then model_probability * 100 - yes_ask end as ye, case when confidence is not null then (1 - model_probability) * 100 - no_ask end as ne from priced),
best as (select *, greatest(ye, ne) as b, case when ye is not null and (ne is null or ye >= ne) then 'yes' when ne is not null then 'no' end as side from edged),
slate as (select *, floor(b * 100 + 0.5) / 100 as edge_points, floor(b * case confidence when 'high' then 1.0 when 'medium' then 0.7 else 0.4 end::double * 100 + 0.5) / 100 as adjusted_edge from best)"""


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.orders(spark, sf_dir)
    status = F.when(T.every("event_id", 41), "unresolved").when(T.every("event_id", 37), "ambiguous").when(T.every("event_id", 8), "manual_override").otherwise("resolved")
    return o.select(
        F.col("event_id").alias("contract_id"), F.concat(F.lit("C"), "event_id").alias("ticker"), "entity_id", "event_id", F.lit("price").alias("stat_type"),
        (24.5 + 50 * (F.col("event_id") % 9)).alias("threshold"), F.when(T.every("event_id", 23), "delisted").otherwise("active").alias("status"),
        status.alias("resolution_status"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = T.table(spark, sf_dir, "lineitem")
    ask = N.book_side(F.col("l_quantity") * 2)
    bid = N.book_side(ask - 2)
    return i.select(
        F.col("l_orderkey").alias("contract_id"), ((F.col("l_partkey") * 10000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")).alias("observation_id"),
        (F.col("l_shipdate") + T.hours(F.col("l_linenumber"))).alias("observed_at"), bid.alias("yes_bid"), ask.alias("yes_ask"),
        N.book_side(100 - ask).alias("no_bid"), N.book_side(100 - bid).alias("no_ask"),
    )


def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored projections: each is preceded by one a day older that must lose."""
    g = stored_run(spark, sf_dir)["graded"].where("projected_value is not null").select(
        F.col("target_id").alias("projection_id"), "entity_id", "event_id", F.col("measure").alias("stat_type"), "distribution_kind", "params", "confidence",
        F.col("cutoff").alias("computed_at"), F.col("cutoff").alias("information_cutoff"),
    )
    older = g.withColumns({"projection_id": F.concat(F.lit("old:"), "projection_id"), "computed_at": F.col("computed_at") - T.days(1), "confidence": F.lit("low"),
                           "distribution_kind": F.lit("retired")})
    return g.unionByName(older)


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures(spark, sf_dir).join(T.orders(spark, sf_dir).select("event_id", "o_orderstatus"), "event_id")
    return f.select("event_id", "season", F.col("valid_at").alias("kickoff_at"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("scheduled").alias("status"),
                    F.col("home_team").cast("string").alias("home_team"), F.col("away_team").cast("string").alias("away_team"))


@query(S.with_(*RUN) + f""", {_SLATE}, {_FACTS}
select s.contract_id, s.ticker, s.side, {S.rnd('s.model_probability', 6)} as model_probability, {S.rnd('s.edge_points', 1)} as edge_points, {S.rnd('s.adjusted_edge', 1)} as adjusted_edge,
       s.confidence, s.yes_ask, case when s.cutoff is not null then coalesce(f.latest_fact_known_at > s.cutoff, false) end as is_stale
from slate s left join facts f using (event_id)
where s.status = 'active' and s.resolution_status in ('resolved', 'manual_override') and s.o_orderstatus <> 'F' and s.kickoff_at > timestamp '{NOW}'""")
def slate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked slate: freshest projection, freshest price, edge, staleness."""
    rows, _ = MK.slate(contracts(spark, sf_dir), games(spark, sf_dir), projections(spark, sf_dir), quotes(spark, sf_dir), latest_facts(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return rows.select("contract_id", "ticker", "side", rnd("model_probability", 6), rnd("edge_points", 1), rnd("adjusted_edge", 1), "confidence", "yes_ask", "is_stale")


@query(S.with_(S.LINES) + f"""
select 'C' || event_id as ticker, case when event_id % 41 = 0 then 'unresolved' else 'ambiguous' end as resolution_status from order_events
where event_id % 23 <> 0 and (event_id % 41 = 0 or event_id % 37 = 0) and o_orderstatus <> 'F' and valid_at > timestamp '{NOW}'""")
def unresolved_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts that could not be resolved, in their own output."""
    _, rows = MK.slate(contracts(spark, sf_dir), games(spark, sf_dir), projections(spark, sf_dir), quotes(spark, sf_dir), latest_facts(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return rows.select("ticker", "resolution_status")


@query(S.with_(*RUN) + f""", {_SLATE}
select contract_id, side, {S.rnd('edge_points', 1)} as edge_points, case side when 'yes' then yes_ask when 'no' then no_ask end as ask_cents, coalesce(adjusted_edge >= 5, false) as is_recommended
from slate where status = 'active' and resolution_status in ('resolved', 'manual_override') and o_orderstatus <> 'F' and contract_id % 4 <> 0
and kickoff_at > timestamp '{NOW}' and kickoff_at <= timestamp '{NOW}' + interval '90 days'""")
def final_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts about to start and not yet captured, frozen once."""
    stored = contracts(spark, sf_dir).where(T.every("contract_id", 4)).select("contract_id", F.lit("final_pre_kickoff").alias("trigger"))
    out = MK.final_snapshots(contracts(spark, sf_dir), games(spark, sf_dir), stored, projections(spark, sf_dir), quotes(spark, sf_dir), F.lit(NOW).cast("timestamp"), minutes=90 * 1440)
    return out.select("contract_id", "side", rnd("edge_points", 1), "ask_cents", "is_recommended")


@query("""
select 'C' || o_orderkey as ticker from orders where o_orderkey % 23 <> 0 and o_orderkey not in (select l_orderkey from lineitem)""")
def delist_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active contracts a complete discovery no longer lists."""
    seen = T.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("C"), "l_orderkey").alias("ticker"))
    sync = seen.agg(F.lit(0).alias("failures"), F.count("*").alias("discovered"))
    return MG.delist(contracts(spark, sf_dir).withColumn("series", F.lit("S")), seen, sync, ("S",)).select("ticker")


_LIVE = f""",
targets as (
  select o.event_id || ':price' as target_id, o.entity_id, o.event_id, o.season, e.position, o.valid_at, timestamp '{NOW}' as cutoff, 'price' as measure, 'x' as era
  from order_events o join entities e using (entity_id) where o.valid_at > timestamp '{NOW}' and o.o_orderstatus <> 'F' and o.event_id % 41 <> 0 and o.event_id % 37 <> 0)"""


@query(S.with_(S.LINES, _LIVE, S.HISTORY, S.PRIORS, S.FIT) + f"""
select entity_id, event_id, n_eff, confidence, {S.rnd('projected_value', 3)} as projected_value, {S.rnd('q50', 3)} as projected_median from labelled""")
def live_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projections at one cutoff for every entity a resolved contract asks about."""
    stored = spark.createDataFrame([], "entity_id long, event_id long, measure string, model_version string, cutoff timestamp")
    now = F.lit(NOW).cast("timestamp")
    run = LV.live_projection(contracts(spark, sf_dir), games(spark, sf_dir), T.customers(spark, sf_dir).select("entity_id", "position"),
                             T.corpus(spark, sf_dir).versions, T.registry(spark), stored, now, now)
    return run.projections.select("entity_id", "event_id", "n_eff", "confidence", rnd("projected_value", 3), rnd("projected_median", 3))


@query("""
with a as (select event_id as run_id, (['ingest', 'recompute', 'price_refresh'])[(user_id % 3 + 1)::int] as category,
                  case event_type when 'click' then 'succeeded' when 'view' then 'succeeded' when 'error' then 'failed' else 'running' end as status,
                  ts - interval '8217 days' as started_at from events),
n as (select timestamp '2001-07-31 20:00:00' as now),
l as (select category, arg_max({'s': status, 't': started_at}, (started_at, run_id)) as a, max(case when status = 'succeeded' then started_at + interval '10 minutes' end) as ok from a group by 1),
x as (select (select count(*) > 0 from orders, n where o_orderstatus <> 'F' and o_orderdate + to_hours((o_orderkey % 24)::int) between now and now + interval '7 days') as expected,
             (select count(*) > 0 from orders, n where o_orderstatus <> 'F' and o_orderdate + to_hours((o_orderkey % 24)::int) between now and now + interval '6 hours') as gameday)
select l.category, l.a.s as last_attempt_outcome, l.ok as last_success_at,
  case when not expected then 'not_expected' when l.a.s = 'running' and epoch(now - l.a.t) / 60.0 > 120 then 'failed' when l.a.s = 'running' then 'running'
       when l.a.s = 'failed' then 'failed' when l.ok is null then 'never_run'
       when epoch(now - l.ok) / 60.0 > case when category <> 'price_refresh' then 1560 when gameday then 30 else 120 end then 'late' else 'ok' end as state
from l cross join n cross join x""")
def health_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three signals from run records and the schedule."""
    e = T.table(spark, sf_dir, "events")
    category = F.array(F.lit("ingest"), F.lit("recompute"), F.lit("price_refresh"))[(F.col("user_id") % 3).cast("int")]
    status = F.when(F.col("event_type").isin("click", "view"), "succeeded").when(F.col("event_type") == "error", "failed").otherwise("running")
    started = F.col("ts") - T.days(8217)
    attempts = e.select(F.col("event_id").alias("run_id"), category.alias("category"), status.alias("status"), started.alias("started_at"),
                        F.when(status != "running", started + F.expr("INTERVAL 10 MINUTES")).alias("finished_at"))
    out = R.health_signals(attempts, games(spark, sf_dir), F.lit("2001-07-31 20:00:00").cast("timestamp"))
    return out.select("category", "last_attempt_outcome", "last_success_at", "state")


_LOG = """
log as (
  select user_id || ':' || (event_id % 3) || ':' || ts::date as run_id, 'c' || (user_id % 5) as category, user_id || ':' || ts::date as invocation_id,
         case when event_id % 4 <> 0 then 'started' else 'finished' end as kind, (['succeeded', 'failed', 'partial'])[((event_id // 4) % 3 + 1)::int] as status,
         case when (event_id // 4) % 3 = 1 then 'e' || (event_id % 10) end as error_message, ts as "at", event_id as seq from events),
per as (
  select run_id, arg_min({'at': "at", 'seq': seq, 'category': category, 'invocation_id': invocation_id}, ("at", seq)) filter (kind = 'started') as s,
         arg_max({'at': "at", 'status': status, 'error': error_message}, ("at", seq)) filter (kind = 'finished') as f, count(*) filter (kind = 'finished') as reports from log group by 1),
runs as (
  select s.category as category, s.invocation_id as invocation_id, arg_min({'at': s.at, 'run_id': run_id, 'f': f, 'reports': reports}, (s.at, s.seq)) as r, count(*) as deliveries
  from per where s is not null group by 1, 2)"""


@query("with " + _LOG + """
select r.run_id as run_id, category, invocation_id, case when r.f is not null then r.f.status when r.at < timestamp '2024-01-25 00:00:00' - interval '24 hours' then 'interrupted' else 'running' end as status,
       r.at as started_at, case when r.f is null and r.at < timestamp '2024-01-24 00:00:00' then timestamp '2024-01-25 00:00:00' else r.f.at end as finished_at,
       case when r.f is null and r.at < timestamp '2024-01-24 00:00:00' then 'abandoned: no report in time' else r.f.error end as error_message,
       deliveries, greatest(r.reports - 1, 0) as late_reports from runs""")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs folded from a log whose entries repeat, come late, or never end."""
    return MG.fold_runs(run_log(spark, sf_dir), F.lit("2024-01-25 00:00:00").cast("timestamp"))


@query("with " + _LOG + """
select l.run_id, l.seq, l.status from log l where kind = 'finished' and run_id not in (select r.run_id from runs)""")
def ignored_run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal entries of repeated deliveries and of runs that never started."""
    log = run_log(spark, sf_dir)
    return MG.ignored_reports(log, MG.fold_runs(log, F.lit("2024-01-25 00:00:00").cast("timestamp"))).select("run_id", "seq", "status")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.col("event_id") / 4) % 3
    day = F.col("ts").cast("date").cast("string")
    return T.table(spark, sf_dir, "events").select(
        F.concat_ws(":", "user_id", F.col("event_id") % 3, day).alias("run_id"), F.concat(F.lit("c"), F.col("user_id") % 5).alias("category"), F.concat_ws(":", "user_id", day).alias("invocation_id"),
        F.when(F.col("event_id") % 4 != 0, MG.LOG_STARTED).otherwise(MG.LOG_FINISHED).alias("kind"), F.array(F.lit("succeeded"), F.lit("failed"), F.lit("partial"))[n.cast("int")].alias("status"),
        F.when(n == 1, F.concat(F.lit("e"), F.col("event_id") % 10)).alias("error_message"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


HEALTH_NOWS = ("2001-07-04 09:00:00", "2001-07-10 20:00:00", "2001-07-20 06:00:00", "2001-07-31 20:00:00", "2001-12-01 00:00:00")
DATASETS = ("schedule", "pbp", "stats", "context", "weather")


@query(f"""
with nows as (select unnest([{', '.join(f"timestamp '{n}'" for n in HEALTH_NOWS)}]) as now),
base as (select event_id as run_id, (['ingest', 'recompute', 'price_refresh'])[(user_id % 3 + 1)::int] as category,
                case event_type when 'click' then 'succeeded' when 'view' then 'succeeded' when 'error' then 'failed' else 'running' end as status, ts - interval '8217 days' as started_at from events),
a as (select n.now, b.* from nows n join base b on b.started_at <= n.now),
l as (select now, category, arg_max({{'s': status, 't': started_at, 'id': run_id}}, (started_at, run_id)) as a, max(case when status = 'succeeded' then started_at + interval '10 minutes' end) as ok from a group by 1, 2),
x as (select now, (select count(*) > 0 from orders where o_orderstatus <> 'F' and o_orderdate + to_hours((o_orderkey % 24)::int) between now and now + interval '7 days') as expected,
             (select count(*) > 0 from orders where o_orderstatus <> 'F' and o_orderdate + to_hours((o_orderkey % 24)::int) between now and now + interval '6 hours') as gameday from nows),
cycles as (select now, category, a.id as cycle_id from l where not (a.s = 'running' and epoch(now - a.t) / 60.0 <= 120)),
sources as (select run_id as cycle_id, d as source, d in ('{"', '".join(sorted(K.REQUIRED_SOURCES))}') as required, case (run_id + i) % 4 when 0 then 'failed' when 1 then 'degraded' else 'ok' end as state
            from base cross join (select unnest(range(0, {len(DATASETS)})) as i, unnest([{', '.join(f"'{d}'" for d in DATASETS)}]) as d) where category = 'ingest'),
worst as (select cycle_id, count(*) as source_count, count(*) filter (state <> 'ok') as source_bad, arg_max({{'source': source, 'state': state, 'required': required}}, (required, state = 'failed', source)) filter (state <> 'ok') as w from sources group by 1),
outcomes_ as (select run_id as cycle_id, (run_id * 5 + i) % (select count(*) from orders) as k, (run_id + i) % 3 <> 0 as good from base cross join (select unnest(range(0, 5)) as i) where category = 'recompute'),
left_ as (select cycle_id, count(*) as event_count, count(*) filter (not good) as event_behind, arg_min(o_orderkey, (o_orderdate + to_hours((o_orderkey % 24)::int), o_orderkey)) filter (not good) as first_behind
          from outcomes_ join orders on o_orderkey = k join customer on c_custkey = o_custkey group by 1)
select l.now, l.category, case when not expected then 'not_expected' when l.a.s = 'running' and epoch(l.now - l.a.t) / 60.0 > 120 then 'failed' when l.a.s = 'running' then 'running'
       when l.a.s = 'failed' then 'failed' when l.ok is null then 'never_run' when epoch(l.now - l.ok) / 60.0 > case when l.category <> 'price_refresh' then 1560 when gameday then 30 else 120 end then 'late' else 'ok' end as state,
       c.cycle_id, w.source_count, w.source_bad, w.w.source as worst_source, w.w.state as worst_state, w.w.required as worst_required, e.event_count, e.event_behind, e.first_behind
from l join x using (now) left join cycles c on c.now = l.now and c.category = l.category left join worst w on w.cycle_id = c.cycle_id left join left_ e on e.cycle_id = c.cycle_id""")
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three signals at five instants, each with its worst source and the events its last cycle left behind."""
    e = T.table(spark, sf_dir, "events")
    category = F.array(F.lit("ingest"), F.lit("recompute"), F.lit("price_refresh"))[(F.col("user_id") % 3).cast("int")]
    status = F.when(F.col("event_type").isin("click", "view"), "succeeded").when(F.col("event_type") == "error", "failed").otherwise("running")
    started = F.col("ts") - T.days(8217)
    attempts = e.select(F.col("event_id").alias("run_id"), category.alias("category"), status.alias("status"), started.alias("started_at"),
                        F.when(status != "running", started + F.expr("INTERVAL 10 MINUTES")).alias("finished_at"))
    at = F.posexplode(F.array(*[F.lit(d) for d in DATASETS])).alias("i", "dataset")
    n = (F.col("cycle_id") + F.col("i")) % 4
    sources = attempts.where("category = 'ingest'").select(F.col("run_id").alias("cycle_id"), at).select("cycle_id", "dataset", F.when(n == 0, "failed").when(n == 1, "partial").otherwise("success").alias("status"))
    orders = T.table(spark, sf_dir, "orders").count()
    five = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")
    outcomes = attempts.where("category = 'recompute'").select(F.col("run_id").alias("cycle_id"), five).select(
        "cycle_id", ((F.col("cycle_id") * 5 + F.col("i")) % orders).alias("event_id"), F.when((F.col("cycle_id") + F.col("i")) % 3 != 0, "succeeded").otherwise("failed").alias("status"))
    out = None
    for text in HEALTH_NOWS:
        now = F.lit(text).cast("timestamp")
        part = R.health_rollup(attempts.where(F.col("started_at") <= now), sources, outcomes, games(spark, sf_dir), now).withColumn("now", now)
        out = part if out is None else out.unionByName(part)
    return out.where("last_attempt_at is not null").select("now", "category", "state", "cycle_id", "source_count", "source_bad", "worst_source", "worst_state", "worst_required", "event_count", "event_behind", "first_behind")


@query(f"""
select min(year(o_orderdate))::int as season_from, max(year(o_orderdate))::int as season_to from orders
where o_orderstatus <> 'F' and o_orderdate + to_hours((o_orderkey % 24)::int) > timestamp '{NOW}' and o_orderdate + to_hours((o_orderkey % 24)::int) <= timestamp '{NOW}' + interval '7 days'""")
def season_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.upcoming_season_window(games(spark, sf_dir), F.lit(NOW).cast("timestamp"))
