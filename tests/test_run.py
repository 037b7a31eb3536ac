"""Sources, artefacts and a whole run: written, verified, tampered with."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cutline.operators import bitemporal as B
from cutline.operators import digests as DG
from cutline.operators import identity as ID
from cutline.operators import metrics as MT
from cutline.plans import backtest as BT
from cutline.plans import ingest as IN
from cutline.plans import live as LV
from cutline.plans import market_sync as MS
from cutline.plans import summarise as SU
from cutline.session import materialize
from cutline.sources import readers as R
from cutline.sources import writers as W
from cutline.workload import tables as T

SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2023, 9, 7, 12)


def test_contracts_and_ranges(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "season int, x string")
    with pytest.raises(R.SchemaDrift, match="y"):
        R.require_columns(df, ["x", "y"], "stats")
    assert R.season_range(2019, 2021) == [2019, 2020, 2021] and R.parse_seasons("1999-2001") == (1999, 2001)
    for bad in ("x", "2003-2001"):
        with pytest.raises(R.UsageError):
            R.parse_seasons(bad)
    df.write.parquet(str(tmp_path / "teams"))
    with pytest.raises(R.SchemaDrift):
        R.read_source(spark, str(tmp_path / "teams"), "teams")
    assert R.read_dataset(spark, str(tmp_path), "predictions", "a int").count() == 0


def test_samples_and_market_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"players": ["Josh Allen", {"name": "Jo", "ticker": "T"}, {"name": "Al", "id": "9", "ticker": "Z"}]}))
    (tmp_path / "b.json").write_text(json.dumps(["Solo", {"nope": 1}]))
    assert sorted(map(tuple, R.read_samples(spark, str(tmp_path / "a.json")).collect())) == [("Al", "9"), ("Jo", "T"), ("Josh Allen", "Josh Allen")]
    with pytest.raises(R.SchemaDrift):
        R.require_named(R.read_samples(spark, str(tmp_path / "b.json")))
    (tmp_path / "l.txt").write_text('"Solo"\n{"name": "Jo", "id": 7}\n[{"ticker": "T"}, "Al"]\n{"players": ["Em"]}\n{broken\n')
    found = R.read_samples(spark, str(tmp_path / "l.txt"), lines=True).collect()
    assert sorted(map(tuple, found), key=str) == sorted([("Solo", "Solo"), ("Jo", "7"), (None, "T"), ("Al", "Al"), ("Em", "Em"), (None, None)], key=str)
    (tmp_path / "p.json").write_text(json.dumps({"series": "S", "markets": [{"ticker": "A", "yes_bid": 3, "extra": 1}, {"ticker": "B", "floor_strike": 74.5}]}))
    rows = R.read_market_pages(spark, str(tmp_path / "p.json")).orderBy("ticker").collect()
    assert [(r.series, r.ticker, r.yes_bid, r.floor_strike) for r in rows] == [("S", "A", 3.0, None), ("S", "B", None, 74.5)]


def test_coverage_refuses_a_vetoed_season(spark):
    facts = {d: spark.createDataFrame([(2019,), (2020,)], "season int") for d in ("stats", "schedule")}
    covered = R.covered_seasons(facts, spark.createDataFrame([("stats", 2020, "none")], "dataset string, season int, coverage string"))
    R.require_coverage(covered, 2019, 2019)
    with pytest.raises(R.UsageError, match="stats 2020"):
        R.require_coverage(covered, 2019, 2020)


def test_digest_ignores_order_and_clock_but_not_content(spark):
    df = spark.createDataFrame([(i, i * 0.5, NOW) for i in range(50)], "a int, b double, computed_at timestamp")
    base = DG.digest(df).first()
    assert DG.digest(df.orderBy(F.desc("a")).repartition(7).withColumn("computed_at", F.current_timestamp())).first() == base
    assert DG.digest(df.withColumn("b", F.when(F.col("a") == 3, 9.0).otherwise(F.col("b")))).first() != base
    assert DG.digest(df.unionByName(df.limit(1))).first() != base


def test_whole_run_verifies_and_tampering_is_found(spark, tmp_path):
    c = T.corpus(spark, SF)
    run = BT.backtest(c.targets, c.versions, T.actuals(spark, SF), T.registry(spark))
    root = str(tmp_path / "run")
    row = SU.complete_run(spark, run, T.registry(spark), root, {"seasons": "1995-2001"})
    assert W.is_complete(spark, root) and W.read_manifest(spark, root)["config"] == {"seasons": "1995-2001"}
    row = row.withColumns({"code_version": F.lit("abc"), "code_dirty": F.lit(False)})
    checks = SU.verify_run(spark, root, row, strict=True).collect()
    assert len(checks) >= 20 and all(k.ok for k in checks), [k for k in checks if not k.ok]
    totals = row.first()
    assert totals.projected_count + totals.unprojectable_count + totals.excluded_count == totals.candidate_count == c.targets.count()
    edited = row.withColumn("predictions_digest", F.lit("0"))
    assert {k.check for k in SU.verify_run(spark, root, edited).collect() if not k.ok} == {"predictions_digest_holds"}
    aggregates, bins = (materialize(x, "cells") for x in SU.stored_cells(spark, root))
    brier = (F.col("metric") == "brier") & (F.col("population") == "contract_like")
    aggregates.withColumn("value", F.when(brier, F.col("value") + F.lit("0.01").cast("decimal(10,2)")).otherwise(F.col("value")).cast("decimal(28,12)")).write.mode("overwrite").parquet(f"{root}/aggregates")
    bins.where("not (bin_index = 0 and axis = 'all' and metric = 'observed_rate')").write.mode("overwrite").parquet(f"{root}/bins")
    off = {k.check: k.detail for k in SU.verify_run(spark, root, row).collect() if not k.ok}
    assert set(off) == {"aggregate_digest_holds", "calibration_digest_holds", "aggregates_recompute", "bins_recompute"}
    assert off["aggregates_recompute"].startswith("1 cells; threshold/contract_like/-/-/-/-/-/brier: differs")
    named = {(r.section, r.population, r.metric, r.state) for r in SU.recomputation_diff(spark, root, row).where("state <> 'same'").collect()}
    assert ("threshold", "contract_like", "brier", "differs") in named and {n[3] for n in named if n[0] == "bin"} == {"missing"}
    with pytest.raises(Exception):
        W.write_dataset(run.priors, root, "priors")


def test_partition_count_does_not_change_a_run(spark):
    c = T.corpus(spark, SF)
    seen = set()
    for n in (1, 13):
        graded, _ = BT.graded_candidates(c.targets.repartition(n), c.versions.repartition(n), T.actuals(spark, SF), T.registry(spark), bucket_seconds=86400 * n, with_drivers=False)
        seen.add(DG.digest(BT.prediction_rows(graded)).first().digest)
    assert len(seen) == 1


def test_too_many_failures_abort(spark):
    df = spark.range(3).select(F.lit("harness_error").alias("reason"))
    assert BT.check_failures(df, limit=4) == 3
    with pytest.raises(BT.TooManyFailures):
        BT.check_failures(df, limit=3)


def test_cycle_states(spark):
    events = spark.createDataFrame([(1, 2023, NOW + dt.timedelta(days=3), "scheduled")], "event_id int, season int, kickoff_at timestamp, status string")
    log = spark.createDataFrame([("ingest", "seen")], "category string, invocation_id string")
    ok = lambda a, b: "success"

    def boom(a, b):
        raise RuntimeError("down")

    jobs = {"schedule": ok, "pbp": ok, "stats": ok, "context": ok, "weather": boom}
    run = lambda jobs, now=NOW, i="x": IN.run_cycle(spark, events, jobs, now, invocation_id=i, run_log=log)
    assert run(jobs).status == "succeeded" and run(jobs).sources.where("status = 'failed'").count() == 1
    assert run({**jobs, "stats": boom}).error_message == "required source(s) failed: stats"
    assert run(jobs, i="seen").status == "duplicate" and run(jobs, NOW + dt.timedelta(days=30)).status == "not_expected"
    calls = []
    assert LV.gameday(events, F.lit(NOW), calls.append, calls.append) is None and not calls
    LV.gameday(events, F.lit(NOW + dt.timedelta(days=2, hours=20)), lambda w: calls.append("ingest"), lambda w: calls.append("recompute"))
    assert calls == ["ingest", "recompute"]


def test_listings_are_taken_apart_once(spark):
    """every output of a sync reads stored fields; a ticker is split and matched once a row, and one small file is dealt to all tasks."""
    markets = spark.createDataFrame([(f"t{i}", f"KX-26SEP{1 + i % 28:02d}SEANE", "A Bee: 75+ yards", None, None, "KXNFLPASSYDS", None, 40.0, 42.0, 58.0, 60.0) for i in range(200)],
                                    "ticker string, event_ticker string, title string, yes_sub_title string, floor_strike double, series string, close_time string, yes_bid double, yes_ask double, no_bid double, no_ask double").coalesce(1)
    parsed = ID.parse_markets(markets)._jdf.queryExecution().optimizedPlan().toString()
    assert parsed.count("split(event_ticker") == 1
    none = spark.createDataFrame([], MS.CONTRACT)
    games = spark.createDataFrame([(1, dt.datetime(2026, 9, 1, 20), "NE", "SEA")], "event_id long, kickoff_at timestamp, home_team string, away_team string")
    players = spark.createDataFrame([(7, "A Bee")], "entity_id long, full_name string")
    sync = MS.market_sync(markets, spark.createDataFrame([], "what string"), none, spark.createDataFrame([], MS.OBSERVATION), games, players, spark.createDataFrame([], MS.MAPPING), F.lit(NOW))
    for out in (sync.contracts, sync.mappings):
        assert "regexp_extract" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = sync.contracts.collect()
    assert len(rows) == 200 and {r.entity_id for r in rows} == {7} and {r.ticker for r in rows if r.event_id} == {f"t{i}" for i in range(0, 200, 28)}


def test_market_sync_end_to_end(spark):
    m = "ticker string, event_ticker string, title string, yes_sub_title string, status string, close_time string, yes_bid double, yes_ask double, no_bid double, no_ask double, floor_strike double, series string"
    markets = spark.createDataFrame([("a", "KX-23SEP10DETKC", "Josh Allen: 75+", None, "open", None, 40.0, 42.0, 57.0, 0.0, None, "KXNFLRECYDS")], m)
    contracts = spark.createDataFrame([("gone", "S", None, None, None, None, "unresolved", None, "active", None, NOW, NOW)],
                                      "ticker string, series string, entity_id string, event_id string, stat_type string, threshold double, resolution_status string, resolution_note string, status string, close_time timestamp, first_seen_at timestamp, last_seen_at timestamp")
    book = "ticker string, observed_at timestamp, yes_bid int, yes_ask int, no_bid int, no_ask int"
    games = spark.createDataFrame([("g", dt.datetime(2023, 9, 10, 17), "KC", "DET")], "event_id string, kickoff_at timestamp, home_team string, away_team string")
    players = spark.createDataFrame([("p", "Josh Allen")], "entity_id string, full_name string")
    none = spark.createDataFrame([], "external_name string, entity_id string, status string, updated_at timestamp")
    fails = spark.createDataFrame([], "what string")
    sync = MS.market_sync(markets, fails, contracts, spark.createDataFrame([("a", NOW - dt.timedelta(minutes=5), 40, 42, 57, None)], book), games, players, none, F.lit(NOW))
    got = {r.ticker: (r.status, r.resolution_status) for r in sync.contracts.collect()}
    assert got == {"a": ("active", "resolved"), "gone": ("delisted", "unresolved")}
    assert sync.observations.count() == 0 and sync.status.first().status == "complete"
    later = MS.market_sync(markets, fails, contracts, spark.createDataFrame([("a", NOW - dt.timedelta(minutes=15), 40, 42, 57, None)], book), games, players, none, F.lit(NOW))
    assert later.observations.count() == 1 and [r.external_name for r in later.mappings.collect()] == ["Josh Allen"]


def test_a_run_finds_its_candidates(spark):
    """Who was last seen with a team is a candidate, whether or not it played; a late cutoff is counted once for each measure."""
    at = lambda d: dt.datetime(2020, 9, 1, 17) + dt.timedelta(days=d)
    lines = [(e, 10 + w, m, 2020, "A" if e < 3 else "C", "WR", at(7 * w), at(7 * w + 1), float(v))
             for e in (1, 2, 3) for w, v in enumerate((5, 8, 3)) for m in ("price", "lines")]
    line = "entity_id long, event_id long, measure string, season int, team string, position string, valid_at timestamp, published_at timestamp, value double"
    later = [(1, 20, "price", 2021, "A", "WR", at(365), at(366), 7.0), (1, 20, "lines", 2021, "A", "WR", at(365), at(366), 2.0)]
    versions = B.value_versions(spark.createDataFrame(lines + later, line), None)
    actuals = versions.select(*B.LINE, F.col("value").alias("actual"), F.lit(False).alias("correction_applied"))
    event = "event_id long, season int, week int, season_type string, valid_at timestamp, home_team string, away_team string"
    events = spark.createDataFrame([(20, 2021, 1, "REG", at(365), "A", "B"), (21, 2021, 1, "PRE", at(365), "A", "B"), (22, 2023, 1, "REG", at(1000), "A", "C")], event)
    revisions = spark.createDataFrame([], "event_id long, kickoff_at timestamp, known_at timestamp, revision_seq int")
    people = spark.createDataFrame([(1, "WR"), (2, "WR"), (3, "WR")], "entity_id long, position string")
    weather = spark.createDataFrame([(20, "archived_forecast", at(364))], "event_id long, era string, known_at timestamp")
    scope = BT.Scope(2021, 2023, ("price", "lines"))
    run = BT.backtest_from_events(events, revisions, versions, actuals, people, weather, T.registry(spark), scope)
    got = {(r.event_id, r.entity_id, r.measure): (r.outcome, r.reason, r.era, r.era_source) for r in run.candidates.collect()}
    assert got == {
        **{(20, 1, m): ("projected", None, "archived_forecast", "weather_row") for m in ("price", "lines")},
        **{(20, 2, m): ("excluded", "no_actual_stat_line", "archived_forecast", "weather_row") for m in ("price", "lines")},
    }  # event 21 is out of scope, in 22 every last line is of a season too long ago
    late = events.where("event_id = 20").withColumn("cutoff", F.col("valid_at"))
    targets = late.withColumns({"entity_id": F.lit(None).cast("long"), "position": F.lit(None).cast("string"), "measure": F.lit("price"), "target_id": F.lit("20::price"), "era": F.lit("x")})
    graded, _ = BT.graded_candidates(targets, versions, actuals, T.registry(spark), with_drivers=False)
    (row,) = BT.exclusion_rows(graded).collect()
    assert (row.event_id, row.entity_id, row.measure, row.stage, row.reason, row.detail) == (20, None, "price", "harness", "cutoff_after_kickoff", "the cutoff is not before the start")


def test_a_stored_run_writes_its_fitted_rows_only(spark):
    """What follows from a row alone is graded as it is read, so no dataset of the run is written beside the fitted rows."""
    import os

    from cutline.session import checkpoint_dir
    from cutline.workload import model_queries as MQ

    T.corpus(spark, SF)
    MQ._RUNS.clear()
    before = set(os.listdir(checkpoint_dir(spark)))
    run = MQ.stored_run(spark, SF)
    made = {n.rsplit("-", 1)[0] for n in set(os.listdir(checkpoint_dir(spark))) - before}
    assert made == {"fitted", "priors", "prior-requests"}
    assert run["graded"].where("drivers is not null").count() == run["graded"].where("projected_value is not null").count() > 0


def test_marked_thresholds_count_predictions_as_a_distinct_does(spark):
    from cutline.operators import metrics as MT
    from cutline.workload import model_queries as MQ

    marked = materialize(MQ.stored_run(spark, SF)["thresholds"], "thresholds")
    plain = marked.drop("leads", "leads_bin")
    for measured in (MT.threshold_scores, MT.calibration_bins):
        assert sorted(map(str, measured(marked).collect())) == sorted(map(str, measured(plain).collect()))
        assert "hashpartitioning(prediction_id" not in measured(marked)._jdf.queryExecution().executedPlan().toString()


def test_the_registry_is_never_met_by_a_shuffle(spark):
    """It has one row a measure: a shuffle by measure would put all predictions into as many tasks."""
    from cutline.operators import audit as A
    from cutline.operators import metrics as MT

    params = "struct<p_zero:double,mu:double,sigma:double,r:double,p:double>"
    rows = spark.createDataFrame([("p", "price", "projected", True, 60.0, "zil", (0.1, 4.0, 0.5, None, None))],
                                 f"prediction_id string, measure string, outcome string, in_comparison_population boolean, projected_value double, distribution_kind string, params {params}")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for read in (MT.contract_like_sensitivity(rows, T.registry(spark)), MT.population_totals(rows, T.registry(spark)), A.grid_probabilities(rows, T.registry(spark), at=5.5)):
            plan = read._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
