"""As-of reads, history features, priors and candidates over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions import times
from cutline.operators import bitemporal as B
from cutline.operators import context as CX
from cutline.operators import history as H
from cutline.operators import priors as P
from cutline.session import materialize
from cutline.workload import sql as S
from cutline.workload import tables as T
from cutline.workload.catalog import query, rnd

HISTORY = (S.LINES, S.CLOCK, S.HISTORY)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.corpus(spark, sf_dir)
    return H.with_history(c.targets, c.versions, bucket_seconds=H.stream_width(c.targets, c.versions))


@query(S.with_(*HISTORY) + f"""
select target_id, entity_id, event_id, measure, n_eff, {S.rnd('ew_mean', 5)} as ew_mean from features""")
def ew_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing-8 exponentially weighted mean as known at each target's cutoff."""
    return features(spark, sf_dir).select("target_id", "entity_id", "event_id", "measure", "n_eff", rnd("ew_mean", 5))


@query(S.with_(*HISTORY) + f"""
select target_id, {S.rnd('ew_zero', 6)} as ew_zero, {S.rnd('zero_rate', 6)} as zero_rate, {S.rnd('ew_log_mean', 5)} as ew_log_mean,
       {S.rnd('log_sigma', 5)} as log_sigma, {S.rnd('window_variance', 3)} as window_variance, crosses_season, last_team, last_season
from features""")
def form_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything else the fitter reads off the window."""
    return features(spark, sf_dir).select(
        "target_id", rnd("ew_zero", 6), rnd("zero_rate", 6), rnd("ew_log_mean", 5), rnd("log_sigma", 5), rnd("window_variance", 3),
        "crosses_season", "last_team", "last_season",
    )


@query(S.with_(*HISTORY) + f"select target_id, {S.rnd('trailing_five', 5)} as trailing_five from features")
def trailing5_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("target_id", rnd("trailing_five", 5))


@query(S.with_(*HISTORY) + f"select target_id, {S.rnd('season_average', 5)} as season_average from features")
def season_avg_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.corpus(spark, sf_dir)
    out = H.season_totals(c.targets, c.versions, H.stream_width(c.targets, c.versions))
    return out.select("target_id", rnd(H.season_average(), 5, "season_average"))


@query(S.with_(S.LINES, S.CLOCK) + """
select event_id, entity_id, valid_at, cutoff from event_clock""")
def cutoff_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's cutoff from its actual and week-out kickoff."""
    return T.event_clock(spark, sf_dir).select("event_id", "entity_id", "valid_at", "cutoff")


@query(S.with_(S.LINES, S.CLOCK) + """
select c.event_id, arg_max(r.kickoff_at, (r.known_at, r.revision_seq)) as kickoff_at,
       arg_max(r.revision_seq, (r.known_at, r.revision_seq)) as revision_seq
from event_clock c join revisions r on r.event_id = c.event_id and r.known_at <= c.cutoff - interval '36 hours' group by 1""")
def asof_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule as known 36 hours before each cutoff."""
    from cutline.operators import timeline as TL

    asked = T.event_clock(spark, sf_dir).select("event_id", (F.col("cutoff") - T.hours(36)).alias("asked_at"))
    out = TL.asof_latest(asked, T.revisions(spark, sf_dir), ["event_id"], "asked_at", "known_at", ["kickoff_at", "revision_seq"], right_order=["revision_seq"])
    return out.where(F.col("revision_seq").isNotNull()).select("event_id", "kickoff_at", "revision_seq")


@query(S.with_(S.LINES) + """
select event_id, entity_id, measure, version_seq, value, visible_from, visible_to from (
  select l.entity_id, l.event_id, l.measure, 1 as version_seq,
         case when c.has_prior then c.prior_value else l.value end as value,
         greatest(l.published_at, lag(c.known_at) over (partition by l.event_id, l.measure order by c.known_at, c.version)) as visible_from,
         c.known_at as visible_to
  from stat_lines l join corrections c using (entity_id, event_id, measure)
  union all
  select l.entity_id, l.event_id, l.measure, 0, l.value, greatest(l.published_at, x.known_at), null
  from stat_lines l left join (select event_id, measure, max(known_at) as known_at from corrections group by 1, 2) x using (event_id, measure)
) where visible_to is null or visible_to > visible_from""")
def asof_rollback_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value a line has shown and the interval it was the published one."""
    return T.versions(spark, sf_dir).select("event_id", "entity_id", "measure", "version_seq", "value", "visible_from", "visible_to")


@query(S.with_(S.LINES) + f"""
select l.measure, l.season, count(value_then) as n, {S.rnd('sum(value_then)', 2)} as total from (
  select l.*, case when f.first_after is not null and f.first_after.has then f.first_after.val else l.value end as value_then
  from stat_lines l left join (
    select event_id, measure, arg_min({{'has': has_prior, 'val': prior_value}}, known_at) as first_after
    from corrections where known_at > timestamp '1999-06-30 12:00:00' group by 1, 2) f using (event_id, measure)
  where l.published_at <= timestamp '1999-06-30 12:00:00') l
group by 1, 2""")
def corpus_as_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus at one cutoff, corrections rolled back."""
    now = B.visible(T.corpus(spark, sf_dir).versions, F.lit("1999-06-30 12:00:00").cast("timestamp"))
    return now.groupBy("measure", "season").agg(
        F.count("value").alias("n"), rnd(F.sum(F.col("value").cast("decimal(28,9)")), 2, "total")
    )


@query(S.with_(S.LINES, S.CLOCK) + """
select c.event_id, c.entity_id, p.event_id as prev_event_id, p.valid_at as prev_valid_at,
       date_diff('day', p.valid_at::date, c.valid_at::date)::int as rest_days
from event_clock c left join (
  select c.event_id as target, arg_max({'e': h.event_id, 'v': h.valid_at}, (h.valid_at, h.event_id)) as p
  from event_clock c join order_events h on h.entity_id = c.entity_id and h.event_id <> c.event_id and h.valid_at < c.valid_at
       and h.published_at <= c.cutoff group by 1) x on x.target = c.event_id
left join order_events p on p.event_id = x.p.e""")
def prev_event_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rest days since the entity's latest published earlier event."""
    o = T.orders(spark, sf_dir)
    seen = o.select("entity_id", "event_id", "valid_at", "published_at", F.col("event_id").alias("venue"))
    out = B.previous_event(T.event_clock(spark, sf_dir), seen)
    return out.select(
        "event_id", "entity_id", F.col("prev_last_event_id").alias("prev_event_id"), F.col("prev_last_valid_at").alias("prev_valid_at"),
        times.rest_days(F.col("valid_at"), F.col("prev_last_valid_at")).alias("rest_days"),
    )


_KM = """2 * 6371.0 * asin(sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))"""


@query(S.with_(S.LINES, S.CLOCK) + f""",
coords as (select n_nationkey as team, (n_nationkey * 7 % 120 - 60)::double as lat, (n_nationkey * 37 % 340 - 170)::double as lon from nation),
teams as (select distinct event_id, team from lines_wide),
prior_event as (
  select c.event_id, arg_max(h.event_id, (h.valid_at, h.event_id)) as prev_event_id
  from event_clock c join order_events h on h.entity_id = c.entity_id and h.event_id <> c.event_id and h.published_at <= c.cutoff group by 1)
select p.event_id, p.prev_event_id, {S.rnd(_KM, 1)} as travel_km
from prior_event p join teams ta on ta.event_id = p.prev_event_id join teams tb on tb.event_id = p.event_id
join coords a on a.team = ta.team join coords b on b.team = tb.team""")
def travel_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Great-circle distance from the previous event's venue."""
    w = T.lines_wide(spark, sf_dir)
    coords = T.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("team"), (F.col("n_nationkey") * 7 % 120 - 60).cast("double").alias("latitude"),
        (F.col("n_nationkey") * 37 % 340 - 170).cast("double").alias("longitude"),
    )
    seen = w.select("entity_id", "event_id", "valid_at", "published_at", F.col("team").alias("venue"))
    asked = T.event_clock(spark, sf_dir).join(w.select("event_id", F.col("team").alias("home")), "event_id")
    out = CX.travel(B.previous_event(asked, seen), coords, F.col("home"))
    return out.where(F.col("prev_last_event_id").isNotNull()).select(
        "event_id", F.col("prev_last_event_id").alias("prev_event_id"), rnd("travel_km", 1)
    )


_GAMES = """,
months as (select distinct date_trunc('month', o_orderdate) as month_start from orders),
games as (
  select n.n_nationkey * 100000 + date_diff('day', date '1990-01-01', w.month_start::date) as event_id, year(w.month_start)::int as season,
         n.n_nationkey as home_team, (n.n_nationkey + 7) % 25 as away_team,
         w.month_start + interval '17 hours' as valid_at, w.month_start + interval '15 hours 30 minutes' as cutoff
  from nation n cross join months w)"""


@query(S.with_(S.LINES) + _GAMES + """,
prices as (
  select l.*, c1.known_at as k1, c1.has_prior as h1, c1.prior_value as p1, c2.known_at as k2, c2.prior_value as p2
  from stat_lines l
  left join corrections c1 on c1.event_id = l.event_id and c1.measure = l.measure and c1.version = 2
  left join corrections c2 on c2.event_id = l.event_id and c2.measure = l.measure and c2.version = 3),
shown as (
  select entity_id, measure, event_id, season, team, valid_at, published_at as since, coalesce(k1, timestamp '9999-01-01') as until,
         case when k1 is null or not h1 then value else p1 end as v from prices
  union all
  select entity_id, measure, event_id, season, team, valid_at, k1, coalesce(k2, timestamp '9999-01-01'), case when k2 is null then value else p2 end
  from prices where k1 is not null
  union all
  select entity_id, measure, event_id, season, team, valid_at, k2, timestamp '9999-01-01', value from prices where k2 is not null),
visible as (select * from shown where v is not null),
times_ as (select distinct cutoff from games),
last_seen as (
  select t.cutoff, s.entity_id, s.measure, arg_max({'team': s.team, 'season': s.season}, (s.valid_at, s.event_id)) as l
  from times_ t join visible s on s.since <= t.cutoff and s.until > t.cutoff group by 1, 2, 3)
select g.event_id, l.entity_id, l.measure, l.l.team as last_team
from games g join last_seen l on l.cutoff = g.cutoff and l.l.team in (g.home_team, g.away_team) and l.l.season in (g.season, g.season - 1)""")
def candidate_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who was, as of each monthly fixture's cutoff, last seen with one of its teams."""
    c = T.corpus(spark, sf_dir)
    months = T.table(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").alias("w")).distinct()
    games = months.withColumn("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(24)))).select(
        (F.col("n_nationkey") * 100000 + F.datediff("w", F.lit("1990-01-01").cast("date"))).cast("long").alias("event_id"),
        F.year("w").alias("season"), F.col("n_nationkey").alias("home_team"), ((F.col("n_nationkey") + 7) % 25).alias("away_team"),
        (F.col("w") + T.hours(17)).alias("valid_at"), (F.col("w") + F.expr("INTERVAL '15:30' HOUR TO MINUTE")).alias("cutoff"),
    )
    return H.candidate_universe(games, c.versions).select("event_id", "entity_id", "measure", "last_team")


@query(S.with_(S.LINES, S.CLOCK, S.PRIORS) + f"""
select season, measure, position, sample_games, sample_players, {S.rnd('p_zero', 6)} as p_zero, {S.rnd('mu', 5)} as mu,
       {S.rnd('sigma', 5)} as sigma, {S.rnd('mean', 5)} as mean, {S.rnd('variance', 3)} as variance,
       array_to_string(fitted_from_seasons, ',') as fitted_from_seasons from priors""")
def walk_forward_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population priors per (season, measure, segment) from earlier seasons only."""
    c = T.corpus(spark, sf_dir)
    requests = materialize(P.prior_requests(c.targets.where(F.col("cutoff") < F.col("valid_at"))), "prior-requests")
    out = P.walk_forward_priors(c.versions, requests)
    return out.select(
        "season", "measure", "position", "sample_games", "sample_players", rnd("p_zero", 6), rnd("mu", 5), rnd("sigma", 5),
        rnd("mean", 5), rnd("variance", 3), F.concat_ws(",", F.col("fitted_from_seasons").cast("array<string>")).alias("fitted_from_seasons"),
    )


@query(f"""
select c_mktsegment, count(v) as sample_games, {S.rnd("1 - count(case when v > 0 then 1 end) / count(v)::double", 6)} as p_zero,
       {S.rnd("avg(case when v > 0 then ln(v) end)", 5)} as mu, {S.rnd("stddev_samp(case when v > 0 then ln(v) end)", 5)} as sigma,
       {S.rnd("avg(v)", 4)} as mean, {S.rnd("var_samp(v)", 2)} as variance
from (select c_mktsegment, c_acctbal as v from customer) group by 1""")
def population_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both families' moments of account balances per segment."""
    c = T.table(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_acctbal").alias("value"))
    out = P.population_moments(c, ["c_mktsegment"])
    return out.select("c_mktsegment", "sample_games", rnd("p_zero", 6), rnd("mu", 5), rnd("sigma", 5), rnd("mean", 4), rnd("variance", 2))


@query(S.with_(S.LINES) + """,
obs as (select event_id as observation_id, user_id, ts as known_at, event_type,
               json_extract_string(props, '$.k') as text_value from events),
asked as (select distinct user_id, event_type, date_trunc('day', ts) + interval '12 hours' as cutoff from events)
select a.user_id, a.event_type, a.cutoff, arg_max(o.text_value, (o.known_at, o.observation_id)) as text_value
from asked a left join obs o on o.user_id = a.user_id and o.event_type = a.event_type and o.known_at <= a.cutoff group by 1, 2, 3""")
def latest_designation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text observation most recently known at each daily noon."""
    e = T.table(spark, sf_dir, "events")
    obs = e.select("user_id", "event_type", F.col("ts").alias("known_at"), F.get_json_object("props", "$.k").alias("text_value"),
                   F.col("event_id").alias("observation_id"))
    asked = e.select("user_id", "event_type", (F.date_trunc("day", "ts") + T.hours(12)).alias("cutoff")).distinct()
    out = CX.latest_observation(asked, obs, ["user_id", "event_type"], "text_value", order=["observation_id"], bucket_seconds=86400)
    return out.select("user_id", "event_type", "cutoff", F.col("latest_text_value").alias("text_value"))


@query("""
select e.user_id, e.event_type, count(*) as seen, max(e.ts) as last_known
from events e join (select user_id, min(ts) + interval '10 days' as cutoff from events group by 1) a
  on a.user_id = e.user_id and e.ts <= a.cutoff group by 1, 2""")
def observations_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations of each entity known ten days after its first."""
    e = T.table(spark, sf_dir, "events").withColumn("known_at", F.col("ts"))
    asked = e.groupBy("user_id").agg((F.min("ts") + T.days(10)).alias("cutoff"))
    seen = CX.observations_as_of(e, asked, ["user_id"])
    return seen.groupBy("user_id", "event_type").agg(F.count("*").alias("seen"), F.max("ts").alias("last_known"))
