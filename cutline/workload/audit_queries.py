"""Leakage audit, run records, registry and report reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions import rows as RW
from cutline.functions import text as TX
from cutline.operators import audit as A
from cutline.operators import merges as MG
from cutline.operators import runs as R
from cutline.operators import timeline as TL
from cutline.sources import readers as SR
from cutline.workload import sql as S
from cutline.workload import tables as T
from cutline.workload.catalog import query, rnd
from cutline.workload.model_queries import RUN, stored_run


@query(S.with_(S.LINES, S.CLOCK) + """,
facts as (select entity_id, event_id as record_id, published_at as known_at from order_events),
context as (select entity_id, event_id as record_id, published_at + interval '2 hours' as known_at from order_events where event_id % 2 = 0),
f as (select t.event_id as target_id, f.record_id, row_number() over (partition by t.event_id order by f.known_at, f.record_id) as nth
      from event_clock t join facts f on f.entity_id = t.entity_id and f.known_at > t.cutoff),
n as (select t.event_id as target_id, count(x.nth) as n from event_clock t left join f x on x.target_id = t.event_id group by 1),
c as (select t.event_id as target_id, f.record_id, row_number() over (partition by t.event_id order by f.known_at, f.record_id) as nth
      from event_clock t join context f on f.entity_id = t.entity_id and f.known_at > t.cutoff)
select target_id, 'fact' as kind, nth::int as nth, record_id from f where nth <= 10
union all select c.target_id, 'context', c.nth::int, c.record_id from c join n using (target_id) where c.nth <= 10 - n.n""")
def leakage_hidden_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target, the first ten records its cutoff hides: facts, then context."""
    o = T.orders(spark, sf_dir)
    facts = o.select("entity_id", F.col("event_id").alias("record_id"), F.col("published_at").alias("known_at"), F.lit("line").alias("detail"))
    context = o.where(T.every("event_id", 2)).select("entity_id", F.col("event_id").alias("record_id"), (F.col("published_at") + T.hours(2)).alias("known_at"),
                                                     F.lit("note").alias("detail"))
    asked = T.event_clock(spark, sf_dir).select(F.col("event_id").alias("target_id"), "entity_id", "cutoff")
    return A.hidden_records(asked, facts, context).select("target_id", "kind", "nth", "record_id")


@query("""
with asked as (select user_id, min(ts) + interval '15 days' as cutoff from events group by 1),
obs as (select user_id, event_type as source, ts as known_at, json_extract_string(props, '$.k') as value from events)
select a.user_id as target_id, o.source, arg_max(o.value, (o.known_at, o.value)) as value, max(o.known_at) as known_at
from asked a join obs o on o.user_id = a.user_id and o.known_at <= a.cutoff group by 1, 2""")
def latest_visible_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest record per source that a cutoff could see."""
    e = T.table(spark, sf_dir, "events")
    obs = e.select("user_id", F.col("event_type").alias("source"), F.col("ts").alias("known_at"), F.get_json_object("props", "$.k").alias("value"))
    asked = e.groupBy("user_id").agg((F.min("ts") + T.days(15)).alias("cutoff")).withColumn("target_id", F.col("user_id"))
    return A.latest_visible(asked, obs, ["user_id"], bucket_seconds=7 * 86400)


_RUNS = """runs as (
  select event_id as run_id, 'm' || (user_id % 5) as model_version, (['development', 'validation', 'holdout'])[(event_id % 3 + 1)::int] as evaluation_window,
         date_trunc('hour', ts) as started_at, case event_type when 'click' then 'running' when 'view' then 'completed' else 'failed' end as status from events)"""


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    window = F.array(F.lit("development"), F.lit("validation"), F.lit("holdout"))[(F.col("event_id") % 3).cast("int")]
    return e.select(F.col("event_id").alias("run_id"), F.concat(F.lit("m"), F.col("user_id") % 5).alias("model_version"), window.alias("evaluation_window"),
                    F.date_trunc("hour", "ts").alias("started_at"),
                    F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "completed").otherwise("failed").alias("status"))


@query(f"""with {_RUNS} select run_id, model_version, started_at from runs where model_version = 'm2' and evaluation_window = 'holdout'
order by started_at desc, run_id desc limit 25""")
def run_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing report: newest first, id tiebreak, limited."""
    out = R.list_runs(run_rows(spark, sf_dir), model_version="m2", evaluation_window="holdout", limit=25)
    return out.select("run_id", "model_version", "started_at")


@query(f"with {_RUNS} select distinct model_version from runs where evaluation_window = 'holdout'")
def holdout_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.holdout_model_versions(run_rows(spark, sf_dir))


@query(f"""with {_RUNS} select case when status = 'running' and started_at < timestamp '2024-01-20 00:00:00' - interval '24 hours' then 'interrupted' else status end as status, count(*) as runs
from runs group by 1""")
def stale_run_reaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs left running past a day become interrupted."""
    runs = run_rows(spark, sf_dir).withColumns({"error_message": F.lit(None).cast("string"), "finished_at": F.lit(None).cast("timestamp")})
    out = MG.reap_stale_runs(runs, F.lit("2024-01-20").cast("timestamp"))
    return out.groupBy("status").agg(F.count("*").alias("runs"))


@query("""
select user_id as run_id, event_type as event_id, arg_max(event_id, (ts, event_id)) as outcome from events group by 1, 2""")
def event_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest outcome per (run, event): a retry replaces its own row."""
    e = T.table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("event_id"), F.col("ts").alias("finished_at"), F.col("event_id").alias("status"))
    return MG.event_outcomes(rows).select("run_id", "event_id", F.col("status").alias("outcome"))


@query("""
with r as (select event_type || (user_id % 7) as category, date_trunc('hour', ts) as invocation_id, event_id as run_id, ts as started_at from events)
select category, invocation_id, arg_min(run_id, (started_at, run_id)) as run_id from r
where (category, invocation_id) not in (select category, invocation_id from r where run_id % 50 = 0) group by 1, 2""")
def invocation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invocations not yet recorded, re-deliveries folded to the first."""
    e = T.table(spark, sf_dir, "events")
    rows = e.select(F.concat("event_type", F.col("user_id") % 7).alias("category"), F.date_trunc("hour", "ts").alias("invocation_id"),
                    F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"))
    return MG.pipeline_start(rows.where(T.every("run_id", 50)), rows).select("category", "invocation_id", "run_id")


@query("""
select event_id, case when f > 0 and d = 0 and u = 0 then 'failed' when f > 0 then 'partial' when d = 0 then 'empty' else 'complete' end as status,
  case when event_id % 4 = 0 then 'running' when f > 0 then 'failed' else 'succeeded' end as attempt
from (select event_id, event_id % 2 as f, event_id % 3 as d, event_id % 5 as u from events)""")
def sync_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sync status from counters, and as a run attempt."""
    e = T.table(spark, sf_dir, "events").select("event_id", F.when(~T.every("event_id", 4), F.col("ts")).alias("finished_at"))
    status = RW.sync_status(F.col("event_id") % 2, F.col("event_id") % 3, F.col("event_id") % 5)
    return e.select("event_id", status.alias("status"), RW.attempt_status(status, F.col("finished_at")).alias("attempt"))


@query("""
select event_id, replace(regexp_replace('job ' || event_id || ' failed at postgresql://u' || user_id || ':pw@host/db for tok' || (event_id % 3) || ' see http', '://[^\\s/@]+@', '://<redacted>@'),
  'tok1', '<redacted>') as message from events""")
def error_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credential spans, then known secrets, leave stored messages."""
    e = T.table(spark, sf_dir, "events")
    raw = F.concat(F.lit("job "), "event_id", F.lit(" failed at postgresql://u"), "user_id", F.lit(":pw@host/db for tok"), F.col("event_id") % 3, F.lit(" see http"))
    return e.select("event_id", TX.redact_error(raw, ("tok1",)).alias("message"))


@query("""
select event_id, json_object('event_type', event_type, 'value', value) ->> '$.event_type' as packed_type, (json_object('value', value) ->> '$.value')::double as packed_value from events""")
def payload_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen columns folded into one JSON value and read back."""
    packed = SR.pack_payload(T.table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ("event_type", "value"), as_json=True)
    back = F.from_json("payload", "event_type string, value double")
    return packed.select("event_id", back["event_type"].alias("packed_type"), back["value"].alias("packed_value"))


@query(S.with_(*RUN) + f"""
select target_id, {S.rnd(S.tail_probability("5.5::double"), 5)} as probability from predictions""")
def any_threshold_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold outside the grid, scored from stored parameters with no refit."""
    g = stored_run(spark, sf_dir)["graded"].where("outcome = 'projected'").withColumn("prediction_id", F.col("target_id"))
    out = A.grid_probabilities(g.drop("thresholds"), T.registry(spark), at=5.5)
    return out.select(F.col("prediction_id").alias("target_id"), rnd("probability", 5))


@query(S.with_(*RUN) + """
select event_id, entity_id, measure, (select count(*) from outcomes where reason = 'insufficient_history') as examples_total
from outcomes where reason = 'insufficient_history' order by event_id, entity_id, measure limit 12""")
def exclusion_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's first dozen examples of one reason, with its total."""
    out = A.exclusion_examples(stored_run(spark, sf_dir)["exclusions"], "insufficient_history")
    return out.select("event_id", "entity_id", "measure", "examples_total")


@query(S.with_(S.LINES, S.CLOCK, S.HISTORY, S.PRIORS, S.FIT) + """,
told as (
  select target_id, unnest([1, 2, 3, 4, 5]) as place, unnest([
    n_eff || ' eligible prior games; exponentially-weighted form ' || printf('%.1f', round_even(ew_mean, 1)) || ' ' || measure || '.',
    'Shrunk ' || round_even(400.0::double / (n_eff + 4), 0)::int || '% toward the ' || position || ' prior for ' || season || ', fitted on ' ||
      fitted_from_seasons[1] || '–' || fitted_from_seasons[-1] || ' (' || format('{:,}', sample_games) || ' player-games).',
    case when zero_rate > 0 then 'Produced nothing in ' || round_even(zero_rate * 100, 0)::int || '% of eligible games in the form window.' end,
    case when crosses_season then 'Form window crosses a season boundary.' end,
    'Projected value ' || printf('%.1f', round_even(projected_value, 1)) || ', prior weight ' || printf('%.2f', round_even(4.0::double / (n_eff + 4), 2)) || '.']) as sentence
  from labelled)
select target_id, row_number() over (partition by target_id order by place) - 1 as rank, sentence from told where sentence is not null""")
def driver_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sentences of every projection, in their order."""
    g = stored_run(spark, sf_dir)["graded"].where("projected_value is not null")
    return g.select("target_id", F.posexplode("drivers").alias("rank", "sentence"))


@query("""
select event_id, row_number() over (order by ts, event_id) as place from events""")
def chronological_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total chronological order with an id tiebreak, as places."""
    e = T.table(spark, sf_dir, "events").select("event_id", "ts")
    return TL.global_rank(e, ["ts", "event_id"], "place").select("event_id", "place")
