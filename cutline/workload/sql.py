"""The definitions of ``workload.tables`` in plain SQL, for the checks."""

from __future__ import annotations

from cutline import constants as K
from cutline.functions import normal as NC


def published(ts: str) -> str:
    local = f"((({ts}) at time zone 'UTC') at time zone 'America/New_York')"
    return f"((({local}::date + interval '1 day' + interval '9 hours') at time zone 'America/New_York') at time zone 'UTC')"


def rnd(expr: str, places: int) -> str:
    """Rounded double; the nudge sends decimal ties up on both engines."""
    return f"(round(({expr})::double + 1e-9, {places}) + 0.0)"


ORDERS = f"""
order_events as (
  select o_custkey as entity_id, o_orderkey as event_id, year(o_orderdate)::int as season,
         o_orderdate + to_hours((o_orderkey % 24)::int) as valid_at, o_totalprice, o_orderpriority, o_orderstatus,
         {published("(o_orderdate + to_hours((o_orderkey % 24)::int))")} as published_at
  from orders),
entities as (
  select c_custkey as entity_id, case when c_custkey % 29 <> 0 then c_mktsegment end as position, c_nationkey as home_nation
  from customer)"""

LINES = ORDERS + """,
lines_wide as (
  select o.entity_id, o.event_id, o.season, e.position,
         (e.home_nation + case when o.event_id % 5 = 0 then 1 else 0 end) % 25 as team,
         o.valid_at, o.published_at,
         case when o.event_id % 13 = 0 then null when o.event_id % 17 = 0 then 0.0::double
              else o.o_totalprice / 1000.0::double end as price,
         case when o.event_id % 19 <> 0 then coalesce(i.item_count, 0) end::double as lines
  from order_events o join entities e using (entity_id)
  left join (select l_orderkey as event_id, count(*) as item_count from lineitem group by 1) i using (event_id)),
stat_lines as (
  select entity_id, event_id, season, position, team, valid_at, published_at, 'price' as measure, price as value from lines_wide
  union all
  select entity_id, event_id, season, position, team, valid_at, published_at, 'lines', lines from lines_wide),
corrections as (
  select entity_id, event_id, measure, 2 as version, valid_at + interval '45 days' as known_at,
         (measure = 'price' or event_id % 33 <> 0) as has_prior,
         case when measure = 'price' then coalesce(value * 0.9::double, 100.0) else coalesce(value + 1, 2.0) end as prior_value
  from stat_lines where event_id % 11 = 0
  union all
  select entity_id, event_id, measure, 3, valid_at + interval '90 days', true,
         case when measure = 'price' then value * 0.95::double when event_id % 44 <> 0 then value + 2 end
  from stat_lines where event_id % 22 = 0)"""

CLOCK = """,
revisions as (
  select event_id, valid_at + case when event_id % 21 = 0 then interval '5 hours' when event_id % 7 = 0 then interval '-2 hours'
                                   else interval '0 hours' end as kickoff_at,
         valid_at - interval '200 days' as known_at, 1 as revision_seq from order_events
  union all
  select event_id, valid_at, valid_at - interval '3 days', 2 from order_events where event_id % 7 = 0),
event_clock as (
  select e.entity_id, e.event_id, e.season, e.valid_at,
         least(e.valid_at, k.known_kickoff) - interval '90 minutes' as cutoff
  from order_events e left join (
    select e.event_id, arg_max(r.kickoff_at, (r.known_at, r.revision_seq)) as known_kickoff
    from order_events e join revisions r on r.event_id = e.event_id and r.known_at <= e.valid_at - interval '7 days'
    group by 1) k using (event_id)),
targets as (
  select c.event_id || ':' || m.measure as target_id, c.entity_id, c.event_id, c.season, e.position, c.valid_at, c.cutoff, m.measure,
         case when c.season >= 1999 then 'archived_forecast' else 'reanalysis' end as era
  from event_clock c join entities e using (entity_id) cross join (values ('price'), ('lines')) m(measure))"""

# Every earlier published line of each target, at its value as of the cutoff.
HISTORY = """,
pairs as (
  select t.target_id, t.cutoff, t.season as target_season, h.*
  from targets t join stat_lines h
    on h.entity_id = t.entity_id and h.measure = t.measure and h.valid_at < t.valid_at and h.published_at <= t.cutoff),
rolled as (
  select p.target_id, p.event_id, arg_min({'has': c.has_prior, 'val': c.prior_value}, c.known_at) as first_after
  from pairs p join corrections c on c.event_id = p.event_id and c.entity_id = p.entity_id and c.measure = p.measure and c.known_at > p.cutoff
  group by 1, 2),
history as (
  select * from (
    select p.target_id, p.event_id, p.entity_id, p.measure, p.season, p.target_season, p.team, p.valid_at,
           case when r.first_after is not null and r.first_after.has then r.first_after.val else p.value end as value
    from pairs p left join rolled r on r.target_id = p.target_id and r.event_id = p.event_id)
  where value is not null),
ranked as (
  select *, row_number() over (partition by target_id order by valid_at desc, event_id desc) as rn from history),
windowed as (
  select target_id,
         sum(pow(0.5, (rn - 1) / 4.0)) as w_all,
         sum(pow(0.5, (rn - 1) / 4.0) * value) as wv,
         sum(case when value <= 0 then pow(0.5, (rn - 1) / 4.0) else 0 end) as wz,
         sum(case when value > 0 then pow(0.5, (rn - 1) / 4.0) end) as w_pos,
         sum(case when value > 0 then pow(0.5, (rn - 1) / 4.0) * ln(value) end) as wl,
         count(case when value > 0 then 1 end) as n_pos,
         stddev_samp(case when value > 0 then ln(value) end) as sd_log,
         count(*) as n_win, avg(value) as mean_win, var_samp(value) as var_win,
         avg(case when value = 0 then 1.0 else 0.0 end) as zero_rate,
         avg(case when rn <= 5 then value end) as trailing_five,
         count(distinct season) > 1 as crosses_season,
         arg_min(team, rn) as last_team, arg_min(season, rn) as last_season, max(valid_at) as last_valid_at
  from ranked where rn <= 8 group by 1),
totals as (
  select target_id, count(*) as n_eff,
         avg(case when season = target_season then value end) as season_average
  from history group by 1),
features as (
  select t.*, coalesce(x.n_eff, 0)::int as n_eff, x.season_average, w.trailing_five, w.zero_rate, coalesce(w.crosses_season, false) as crosses_season,
         w.last_team, w.last_season, w.last_valid_at,
         w.wv / w.w_all as ew_mean, w.wz / w.w_all as ew_zero, coalesce(w.wl / w.w_pos, case when w.n_win > 0 then 0.0 end) as ew_log_mean,
         case when w.n_win > 0 then greatest(case when w.n_pos >= 2 then w.sd_log else 0.35 end, 0.35) end as log_sigma,
         case when w.n_win >= 2 then w.var_win else w.mean_win * 1.05 end as window_variance
  from targets t left join totals x using (target_id) left join windowed w using (target_id))"""

PRIORS = """,
prior_requests as (
  select season, measure, position, arg_min(cutoff, (valid_at, event_id)) as prior_cutoff
  from targets where position is not null and cutoff < valid_at group by 1, 2, 3),
evidence as (
  select q.season as for_season, q.measure, q.position, h.entity_id, h.season as seen_season,
         case when r.first_after is not null and r.first_after.has then r.first_after.val else h.value end as value
  from prior_requests q
  join stat_lines h on h.measure = q.measure and h.position = q.position and h.season < q.season and h.published_at <= q.prior_cutoff
  left join (
    select q.season, c.event_id, c.entity_id, c.measure, arg_min({'has': c.has_prior, 'val': c.prior_value}, c.known_at) as first_after
    from prior_requests q join stat_lines h on h.measure = q.measure and h.position = q.position
    join corrections c on c.event_id = h.event_id and c.entity_id = h.entity_id and c.measure = h.measure and c.known_at > q.prior_cutoff
    group by 1, 2, 3, 4) r on r.season = q.season and r.event_id = h.event_id and r.entity_id = h.entity_id and r.measure = h.measure),
priors as (
  select for_season as season, measure, position, count(*) as sample_games, count(distinct entity_id) as sample_players,
         list_sort(list(distinct seen_season)) as fitted_from_seasons,
         1.0 - count(case when value > 0 then 1 end) / count(*)::double as p_zero,
         coalesce(avg(case when value > 0 then ln(value) end), 0.0) as mu,
         greatest(coalesce(stddev_samp(case when value > 0 then ln(value) end), 0.35), 0.35) as sigma,
         avg(value) as mean, coalesce(var_samp(value), avg(value) * 1.05) as variance
  from evidence where value is not null group by 1, 2, 3)"""


def _poly(x: str, ascending: tuple[float, ...]) -> str:
    out = repr(float(ascending[-1]))
    for c in reversed(ascending[:-1]):
        out = f"({out} * {x} + ({float(c)!r}))"
    return out


def erfc(x: str) -> str:
    y, y2 = f"abs({x})", f"(({x}) * ({x}))"
    small = f"(1.0::double - ({x}) * {_poly(y2, NC.ERF_NUM)} / {_poly(y2, NC.ERF_DEN)})"
    middle = f"(exp(-{y2}) * {_poly(y, NC.ERFC_NUM)} / {_poly(y, NC.ERFC_DEN)})"
    inv = f"(1.0::double / {y2})"
    tail = f"(exp(-{y2}) * ({NC.INV_SQRT_PI!r}::double - {inv} * {_poly(inv, NC.TAIL_NUM)} / {_poly(inv, NC.TAIL_DEN)}) / {y})"
    upper = f"(case when {y} <= 4.0 then {middle} when {y} <= 27.0 then {tail} else 0.0 end)"
    return f"(case when {y} <= 0.46875 then {small} when ({x}) < 0 then 2.0 - {upper} else {upper} end)"


def normal_ppf(p: str) -> str:
    q = f"(({p}) - 0.5::double)"
    r0 = f"(0.180625::double - {q} * {q})"
    central = f"({q} * {_poly(r0, NC.PPND_A)} / {_poly(r0, NC.PPND_B)})"
    r = f"sqrt(-ln(least({p}, 1.0::double - ({p}))))"
    near, far = f"({r} - 1.6)", f"({r} - 5.0)"
    outer = (f"(case when {r} <= 5.0 then {_poly(near, NC.PPND_C)} / {_poly(near, NC.PPND_D)} "
             f"else {_poly(far, NC.PPND_E)} / {_poly(far, NC.PPND_F)} end)")
    return f"(case when abs({q}) <= 0.425 then {central} when {q} < 0 then -{outer} else {outer} end)"


def zil_at_least(t: str) -> str:
    z = f"((ln({t}) - mu) / sigma / {NC.SQRT2!r}::double)"
    return f"(case when {t} <= 0 then 1.0 else (1.0 - p_zero) * 0.5 * {erfc(z)} end)"


def zil_quantile(q: float) -> str:
    inner = f"(({q}::double - p_zero) / (1.0 - p_zero))"
    return f"(case when p_zero >= {q} then 0.0 else exp(mu + sigma * {normal_ppf(inner)}) end)"


# The negative binomial PMF in closed form, on enough terms for the test data.
NB_TERMS = 400


def nb_pmf(k: str) -> str:
    return f"exp(lgamma({k} + r) - lgamma(r) - lgamma({k} + 1.0) + r * ln(p) + {k} * ln(1.0 - p))"


FIT_PARAMS = """,
fitted as (
  select f.*, q.sample_games, q.sample_players, q.fitted_from_seasons,
         case when measure = 'price' then least(greatest((n_eff * ew_zero + 4.0 * q.p_zero) / (n_eff + 4.0), 0.0), 1.0) end as p_zero,
         case when measure = 'price' then (n_eff * ew_log_mean + 4.0 * q.mu) / (n_eff + 4.0) end as mu,
         case when measure = 'price' then greatest((n_eff * log_sigma + 4.0 * q.sigma) / (n_eff + 4.0), 0.35) end as sigma,
         case when measure = 'lines' then greatest((n_eff * ew_mean + 4.0 * q.mean) / (n_eff + 4.0), 1e-4) end as nb_mean,
         case when measure = 'lines' then (n_eff * window_variance + 4.0 * q.variance) / (n_eff + 4.0) end as nb_var0
  from features f join priors q using (season, measure, position)
  where f.n_eff >= 1 and f.cutoff < f.valid_at),
params as (
  select *, nb_mean / nb_var as p, nb_mean * nb_mean / (nb_var - nb_mean) as r
  from (select *, greatest(nb_var0, nb_mean * 1.05) as nb_var from fitted))"""

FIT = FIT_PARAMS + f""",
nb_terms as (
  select target_id, k, sum(pmf) over (partition by target_id order by k) as reached, pmf
  from (select target_id, k, {nb_pmf("k::double")} as pmf
        from (select target_id, r, p from params where measure = 'lines') x
        cross join (select unnest(range(0, {NB_TERMS})) as k) g)),
nb_q as (
  select target_id,
         {", ".join(f"min(case when reached >= {q} - 1e-13 then k end)::double as {n}" for q, n in zip(K.QUANTILE_GRID, K.QUANTILE_NAMES))},
         max(case when k = 0 then pmf end) as zero_mass,
         greatest(0.0, 1.0 - max(case when k = 15 then reached end)) as tail_mass
  from nb_terms group by 1),
projected as (
  select t.* exclude (p, r), t.p, t.r,
         case when measure = 'price' then (1.0 - p_zero) * exp(mu + sigma * sigma / 2.0) else nb_mean end as projected_value,
         {", ".join(f"case when measure = 'price' then {zil_quantile(q)} else b.{n} end as {n}" for q, n in zip(K.QUANTILE_GRID, K.QUANTILE_NAMES))},
         b.zero_mass, b.tail_mass
  from params t left join nb_q b using (target_id)),
scored as (
  select *, (q90 - q10) / (case when measure = 'price' then greatest(projected_value, 10.0) else 1.0 + greatest(projected_value, 0.0) end) as relative_width
  from projected),
labelled as (
  select *, case when n_eff < 3 then 'low'
                 when relative_width > (case when measure = 'price' then 2.0 else 1.5 end) then 'low'
                 when n_eff >= 6 and relative_width <= (case when measure = 'price' then 1.45 else 1.1 end) then 'high'
                 else 'medium' end as confidence
  from scored)"""

FIXTURES = f"""
order_lines as (
  select o_orderkey as k, o_custkey as entity_id, date_trunc('quarter', o_orderdate) as q,
         (c_nationkey + case when o_orderkey % 5 = 0 then 1 else 0 end) % 25 as team,
         case when o_orderkey % 13 = 0 then null when o_orderkey % 17 = 0 then 0 else o_totalprice end::decimal(12,2) as price,
         case when o_orderkey % 19 <> 0 then coalesce(i.n, 0) end as lines
  from orders join customer on c_custkey = o_custkey left join (select l_orderkey, count(*) as n from lineitem group by 1) i on l_orderkey = o_orderkey),
entities as (select c_custkey as entity_id, case when c_custkey % 29 <> 0 then c_mktsegment end as position from customer),
fixtures as (
  select n_nationkey * 100000 + date_diff('day', date '1990-01-01', q::date) as event_id, year(q)::int as season, quarter(q)::int as week,
         case when quarter(q) = 4 then 'POST' else 'REG' end as season_type, n_nationkey as home_team, (n_nationkey + 7) % 25 as away_team,
         q + interval '80 days' + interval '17 hours' as valid_at, q
  from nation cross join (select distinct date_trunc('quarter', o_orderdate) as q from orders)),
lines_wide as (
  select l.entity_id, f.event_id, f.season, e.position, l.team, f.valid_at, {published("f.valid_at")} as published_at,
         sum(l.price)::double / 1000.0::double as price, sum(l.lines)::double as lines
  from order_lines l join fixtures f on f.home_team = l.team and f.q = l.q join entities e using (entity_id) group by all),
stat_lines as (
  select entity_id, event_id, season, position, team, valid_at, published_at, 'price' as measure, price as value from lines_wide
  union all
  select entity_id, event_id, season, position, team, valid_at, published_at, 'lines', lines from lines_wide),
corrections as (
  select entity_id, event_id, measure, 2 as version, valid_at + interval '45 days' as known_at,
         (measure = 'price' or (event_id + entity_id) % 33 <> 0) as has_prior,
         case when measure = 'price' then coalesce(value * 0.9::double, 100.0) else coalesce(value + 1, 2.0) end as prior_value
  from stat_lines where (event_id + entity_id) % 11 = 0
  union all
  select entity_id, event_id, measure, 3, valid_at + interval '90 days', true,
         case when measure = 'price' then value * 0.95::double when (event_id + entity_id) % 44 <> 0 then value + 2 end
  from stat_lines where (event_id + entity_id) % 22 = 0),
revisions as (
  select event_id, valid_at + case when event_id % 21 = 0 then interval '5 hours' when event_id % 7 = 0 then interval '-2 hours' else interval '0 hours' end as kickoff_at,
         valid_at - interval '60 days' as known_at, 1 as revision_seq from fixtures
  union all
  select event_id, valid_at, valid_at - interval '3 days', 2 from fixtures where event_id % 7 = 0),
event_clock as (
  select f.*, least(f.valid_at, k.known_kickoff) - interval '90 minutes' as cutoff
  from fixtures f left join (
    select f.event_id, arg_max(r.kickoff_at, (r.known_at, r.revision_seq)) as known_kickoff
    from fixtures f join revisions r on r.event_id = f.event_id and r.known_at <= f.valid_at - interval '7 days' group by 1) k using (event_id)),
shown as (
  select l.*, c1.known_at as k1, c1.has_prior as h1, c1.prior_value as p1, c2.known_at as k2, c2.prior_value as p2
  from stat_lines l
  left join corrections c1 on c1.event_id = l.event_id and c1.entity_id = l.entity_id and c1.measure = l.measure and c1.version = 2
  left join corrections c2 on c2.event_id = l.event_id and c2.entity_id = l.entity_id and c2.measure = l.measure and c2.version = 3),
visible as (
  select * from (
    select entity_id, measure, event_id, season, team, valid_at, published_at as since, coalesce(k1, timestamp '9999-01-01') as until,
           case when k1 is null or not h1 then value else p1 end as v from shown
    union all
    select entity_id, measure, event_id, season, team, valid_at, k1, coalesce(k2, timestamp '9999-01-01'), case when k2 is null then value else p2 end from shown where k1 is not null
    union all
    select entity_id, measure, event_id, season, team, valid_at, k2, timestamp '9999-01-01', value from shown where k2 is not null)
  where v is not null),
last_seen as (
  select t.cutoff, s.entity_id, s.measure, arg_max({{'team': s.team, 'season': s.season}}, (s.valid_at, s.event_id)) as l
  from (select distinct cutoff from event_clock) t join visible s on s.since <= t.cutoff and s.until > t.cutoff group by 1, 2, 3),
targets as (
  select c.event_id || ':' || l.entity_id || ':' || l.measure as target_id, l.entity_id, c.event_id, c.season, e.position, c.valid_at, c.cutoff, l.measure,
         case when c.event_id % 3 = 0 and c.event_id % 2 <> 0 then 'archived_forecast' else 'reanalysis' end as era,
         case when c.event_id % 3 = 0 and c.event_id % 2 <> 0 then 'weather_row' else 'season_rule' end as era_source
  from event_clock c join last_seen l on l.cutoff = c.cutoff and l.l.team in (c.home_team, c.away_team) and l.l.season in (c.season, c.season - 1)
  left join entities e using (entity_id))"""

FOUND = """,
found as (
  select t.target_id, t.event_id, t.entity_id, t.measure, t.season, t.position, t.era, t.era_source, f.n_eff, f.last_team, f.season_average, f.trailing_five, a.value as actual,
         case when t.measure = 'price' then (1.0 - p.p_zero) * exp(p.mu + p.sigma * p.sigma / 2.0) else p.nb_mean end as projected_value,
         f.season_average is not null and f.trailing_five is not null as in_comparison,
         case when q.sample_games is null then 'no_prior_evidence' when f.n_eff < 1 then 'insufficient_history' when a.value is null then 'no_actual_stat_line' end as reason
  from targets t join features f using (target_id)
  left join priors q on q.season = t.season and q.measure = t.measure and q.position = t.position
  left join params p on p.target_id = t.target_id
  left join stat_lines a on a.event_id = t.event_id and a.entity_id = t.entity_id and a.measure = t.measure)"""

OUTCOMES = """,
outcomes as (
  select t.target_id, t.event_id, t.entity_id, t.season, t.measure, t.era, t.position, t.cutoff, t.valid_at,
         l.p_zero, l.mu, l.sigma, l.r, l.p, l.projected_value, l.q10, l.q50, l.q90, l.confidence, l.relative_width, f.n_eff,
         f.season_average, f.trailing_five, a.value as actual, t.event_id % 11 = 0 as correction_applied,
         coalesce(l.projected_value >= case when t.measure = 'price' then 50.0 else 2.0 end, false) as contract_like,
         f.season_average is not null and f.trailing_five is not null as in_comparison,
         case when t.cutoff >= t.valid_at then 'cutoff_after_kickoff'
              when q.sample_games is null then 'no_prior_evidence'
              when f.n_eff < 1 then 'insufficient_history'
              when a.value is null then 'no_actual_stat_line' end as reason
  from targets t join features f using (target_id)
  left join priors q on q.season = t.season and q.measure = t.measure and q.position = t.position
  left join labelled l on l.target_id = t.target_id
  left join stat_lines a on a.event_id = t.event_id and a.measure = t.measure),
predictions as (
  select *, abs(actual - projected_value) as abs_error, pow(actual - projected_value, 2) as sq_error,
         abs(actual - q50) as abs_error_median, pow(actual - q50, 2) as sq_error_median,
         abs(actual - season_average) as season_avg_error, abs(actual - trailing_five) as trailing5_error
  from outcomes where reason is null)"""


def tail_probability(t: str) -> str:
    """P(X >= t) for a row with p_zero, mu, sigma (price) or r, p (lines)."""
    below = f"list_sum([{nb_pmf('j::double')} for j in range(0, ceil({t})::int)])"
    return (f"(case when measure = 'price' then {zil_at_least(t)} "
            f"else greatest(0.0, least(1.0, 1.0 - coalesce({below}, 0.0))) end)")


THRESHOLDS = f""",
grid as (
  select 'price' as measure, 24.5 + 50.0 * i as threshold from range(0, 9) t(i)
  union all select 'lines', 1.5 + i from range(0, 8) t(i)),
thresholds as (
  select *, (actual >= threshold) as outcome,
         round_even({tail_probability("threshold::double")}, 6) as probability
  from (select p.*, g.threshold::double as threshold from predictions p join grid g using (measure)))"""


def with_(*parts: str) -> str:
    return "with " + "".join(parts).strip().lstrip(",")
