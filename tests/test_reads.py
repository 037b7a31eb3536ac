import datetime as dt

from pyspark.sql import functions as F

from cutline import constants as K
from cutline.operators import audit as A
from cutline.operators import context as CX
from cutline.operators import identity as ID
from cutline.operators import market as MK
from cutline.operators import registry as RG
from cutline.operators import runs as R
from cutline.operators import verify as V
from cutline.plans import backtest as BT
from cutline.sources import writers as W

NOW = dt.datetime(2023, 9, 10, 12)


def test_era_comes_from_a_visible_row_or_the_season(spark):
    t = spark.createDataFrame([(1, 2020, NOW), (2, 2020, NOW), (3, 2023, NOW)], "event_id int, season int, cutoff timestamp")
    w = spark.createDataFrame([(1, "archived_forecast", NOW), (2, "archived_forecast", NOW + dt.timedelta(hours=1))], "event_id int, era string, known_at timestamp")
    got = {r.event_id: (r.era, r.era_source) for r in CX.era_label(t, w).collect()}
    assert got == {1: ("archived_forecast", "weather_row"), 2: ("reanalysis", "season_rule"), 3: ("archived_forecast", "season_rule")}


def test_crosswalk_rows_per_present_source(spark):
    p = spark.createDataFrame([("e1", "A B", "g1", 77), ("e2", "C D", "g2", None)], "entity_id string, full_name string, gsis string, espn int")
    got = sorted((r.entity_id, r.source, r.external_id) for r in ID.crosswalk_identities(p, {"nflverse": "gsis", "espn": "espn"}).collect())
    assert got == [("e1", "espn", "77"), ("e1", "nflverse", "g1"), ("e2", "nflverse", "g2")]
    x = spark.createDataFrame([("p1", "g1"), (None, "g2"), ("p3", "")], "pfr string, gsis string")
    assert [tuple(r) for r in CX.crosswalk(x, "pfr", "gsis").collect()] == [("p1", "g1")]


def test_health_details_only_when_something_is_off(spark):
    src = spark.createDataFrame([("c1", "stats", "success"), ("c1", "weather", "failed"), ("c2", "stats", "success")], "cycle_id string, dataset string, status string")
    got = sorted((r.cycle_id, r.source, r.required, r.state) for r in R.source_detail(src).collect())
    assert got == [("c1", "stats", True, "ok"), ("c1", "weather", False, "failed")]
    out = spark.createDataFrame([("c", 1, "succeeded"), ("c", 2, "failed"), ("c", 3, "skipped")], "cycle_id string, event_id int, status string")
    ev = spark.createDataFrame([(i, NOW, "H", "A") for i in (1, 2, 3)], "event_id int, kickoff_at timestamp, home_team string, away_team string")
    rows = {r.event_id: (r.reason, r.current_count, r.total_count, r.label) for r in R.lagging_events(out, ev).collect()}
    assert rows == {2: ("failed this cycle", 1, 3, "A @ H"), 3: ("not recomputed this cycle", 1, 3, "A @ H")}
    runs = spark.createDataFrame([("a", "ingest", "running", NOW - dt.timedelta(minutes=5)), ("b", "recompute", "running", NOW - dt.timedelta(hours=3))], "run_id string, category string, status string, started_at timestamp")
    assert [r.run_id for r in R.detail_cycle(runs, F.lit(NOW)).collect()] == ["b"]


def test_reproduction_and_different_experiments(spark):
    cols = "corpus_digest string, engine_config_digest string, predictions_digest string, aggregate_digest string, calibration_digest string, code_version string, code_dirty boolean"
    a = spark.createDataFrame([("c", "e", "1", "2", "3", "abc", False)], cols)
    same, other, drift = (spark.createDataFrame([r], cols) for r in (("c", "e", "1", "2", "3", "x", True), ("d", "e", "9", "9", "9", "x", True), ("c", "e", "1", "9", "3", "x", True)))
    assert all(r.ok for r in V.check_reproducibility(a, same).collect()) and V.check_reproducibility(a, same).count() == 3
    assert [r.check for r in V.check_reproducibility(a, other).collect()] == ["different experiment"]
    assert [r.check for r in V.check_reproducibility(a, drift).collect() if not r.ok] == ["aggregate_digest reproduces"]
    assert all(r.ok for r in V.check_attribution(a).collect()) and not any(r.ok for r in V.check_attribution(spark.createDataFrame([("c", "e", "", "", "", "unknown", True)], cols)).collect())


def test_explain_and_detail(spark):
    params = "struct<p_zero:double,mu:double,sigma:double,r:double,p:double>"
    pred = spark.createDataFrame([("p1", 1, 5, "receptions", K.KIND_NB, (None, None, None, 4.0, 0.5), NOW, NOW + dt.timedelta(hours=2))],
                                 f"prediction_id string, entity_id int, event_id int, measure string, distribution_kind string, params {params}, cutoff timestamp, valid_at timestamp")
    obs = spark.createDataFrame([(1, 5, "injury", NOW - dt.timedelta(days=2), "Q"), (1, 5, "injury", NOW - dt.timedelta(days=1), "Out"), (1, 5, "injury", NOW + dt.timedelta(days=1), "In")],
                                "entity_id int, event_id int, source string, known_at timestamp, value string")
    facts = spark.createDataFrame([(1, i, NOW + dt.timedelta(days=i - 3), "x") for i in range(15)], "entity_id int, record_id int, known_at timestamp, detail string")
    notes = spark.createDataFrame([(1, 90, NOW + dt.timedelta(days=1), "n")], "entity_id int, record_id int, known_at timestamp, detail string")
    out = A.explain("p1", pred, RG.registry(spark), obs, facts, notes)
    assert not out["row"].first().cutoff_at_or_after_kickoff
    assert [(r.source, r.value) for r in out["visible"].collect()] == [("injury", "Out")]
    assert sorted(r.record_id for r in out["hidden"].collect()) == list(range(4, 14))
    few = A.explain("p1", pred, RG.registry(spark), obs, facts.where("record_id < 6"), notes)["hidden"].collect()
    assert sorted((r.kind, r.record_id) for r in few) == [("context", 90), ("fact", 4), ("fact", 5)]
    grid = out["grid"].orderBy("threshold").collect()
    assert [g.threshold for g in grid] == [1.5 + i for i in range(8)] and all(a.probability >= b.probability for a, b in zip(grid, grid[1:])) and all(g.in_grid for g in grid)

    rows = spark.createDataFrame([(7, "pr", 40, 43)], "contract_id int, projection_id string, yes_bid int, yes_ask int")
    proj = spark.createDataFrame([("pr", {"q50": 3.0}, 3.1, 3.0, 1.0, 6.0, 5)], "projection_id string, quantiles map<string,double>, projected_value double, projected_median double, interval_low double, interval_high double, n_eff int")
    drv = spark.createDataFrame([("pr", 1, "b"), ("pr", 0, "a"), ("zz", 0, "c")], "projection_id string, rank int, text string")
    detail, told = MK.contract_detail(rows, proj, drv, 7)
    assert detail.first().yes_mid == 42 and [r.text for r in told.collect()] == ["a", "b"]


def test_scope_export_and_reload(spark, tmp_path):
    ev = spark.createDataFrame([(3, 2020, "REG", NOW), (1, 2020, "REG", NOW), (2, 2020, "POST", NOW), (4, 2019, "REG", NOW)], "event_id int, season int, season_type string, valid_at timestamp")
    assert [r.event_id for r in BT.events_in_scope(ev, 2020, 2020, limit=1).collect()] == [1]
    assert BT.events_in_scope(ev, 2019, 2020).count() == 3
    W.export_run(ev, str(tmp_path / "x"))
    back = W.reload_run(spark, str(tmp_path / "x"), ev.where("event_id = 1"), ["event_id"])
    assert sorted(r.event_id for r in back.collect()) == [2, 3, 4]


def test_a_new_stat_type_is_one_row(spark):
    extra = (*RG.DEFAULT, RG.StatType("sacks", K.COUNT, (0.5,), 4, None))
    assert RG.registry(spark, extra).count() == len(RG.DEFAULT) + 1 and RG.validate(["sacks"], extra) == ["sacks"]
    try:
        RG.validate(["sacks"])
    except ValueError as exc:
        assert "sacks" in str(exc)
    else:
        raise AssertionError("unregistered stat type accepted")
