import datetime as dt

import pytest
from pyspark.sql import functions as F

from cutline.operators import context as CX
from cutline.operators import identity as ID
from cutline.operators import merges as MG

AT = dt.datetime(2023, 9, 10, 17)
NOW = dt.datetime(2023, 9, 20)
CUR = "entity_id long, event_id long, team string, yards double, version int, valid_at timestamp, known_at timestamp"
INC = "entity_id long, event_id long, team string, yards double, valid_at timestamp, seq int"


def test_corrections_version_log_and_repeat_as_no_op(spark):
    empty = spark.createDataFrame([], CUR)
    first = spark.createDataFrame([(1, 1, "KC", 50.0, AT, 1), (2, 1, "DET", None, AT, 1), (1, 1, "KC", 60.0, AT, 2)], INC)
    one = MG.correction_merge(empty, first, ["yards"], F.lit(NOW), sequence="seq")
    rows = {r.entity_id: r for r in one.current.collect()}
    assert rows[1].yards == 60.0 and rows[1].version == 1 and rows[1].known_at == dt.datetime(2023, 9, 11, 13)
    assert MG.collapsed_rows(first, ["entity_id", "event_id"]).first().collapsed == 1
    again = MG.correction_merge(one.current, first, ["yards"], F.lit(NOW), sequence="seq")
    assert {r.action for r in again.actions.collect()} == {"unchanged"} and again.log.count() == 0
    fixed = spark.createDataFrame([(1, 1, "KC", 61.0, AT, 3), (2, 1, "DET", 0.0, AT, 3)], INC)
    two = MG.correction_merge(one.current, fixed, ["yards"], F.lit(NOW), sequence="seq")
    log = {r.entity_id: r for r in two.log.collect()}
    assert log[1].prior_values == {"yards": 60.0} and log[1].corrected_values == {"yards": 61.0} and log[2].prior_values == {"yards": None}
    now = {r.entity_id: r for r in two.current.collect()}
    assert now[1].version == 2 and now[1].known_at == NOW and now[1].valid_at == AT


def test_schedule_revisions(spark):
    cols = "event_id long, season int, season_type string, home_team string, away_team string, kickoff_at timestamp, venue string, status string"
    new = spark.createDataFrame([(1, 2023, "REG", "KC", "DET", AT, "A", "completed"), (2, 2023, "POST", "KC", "DET", AT, "A", "scheduled"), (3, 2023, "REG", "KC", "DET", None, "A", "scheduled")], cols)
    first = MG.schedule_merge(spark.createDataFrame([], cols), new, F.lit(NOW))
    log = {r.event_id: r for r in first.log.collect()}
    assert log[1].status == "scheduled" and log[1].known_at == dt.datetime(2023, 8, 1, 12) and log[2].known_at == AT - dt.timedelta(days=5)
    assert {r.action: r.rows for r in first.counters().collect()} == {"inserted": 2, "skipped": 1}
    moved = spark.createDataFrame([(1, 2023, "REG", "KC", "DET", AT + dt.timedelta(hours=3), "A", "completed"), (2, 2023, "POST", "KC", "DET", AT, "A", "scheduled")], cols)
    second = MG.schedule_merge(first.current, moved, F.lit(NOW))
    assert [(r.event_id, r.known_at) for r in second.log.collect()] == [(1, NOW)]
    with pytest.raises(MG.UnknownTeam):
        MG.require_known_teams(new, spark.createDataFrame([("KC",)], "team_code string"))


def test_manual_override_survives(spark):
    cols = "source string, external_id string, external_name string, entity_id string, status string, candidate_count long, candidate_hash string"
    cur = spark.createDataFrame([("m", "a", "a", "p9", "manual_override", 1, None), ("m", "b", "b", None, "unresolved", 0, None)], cols)
    inc = spark.createDataFrame([("m", "a", "a", "p1", "resolved", 1, None), ("m", "b", "b", "p2", "resolved", 1, None)], cols)
    out = {r.external_id: (r.entity_id, r.status) for r in ID.identity_upsert(cur, inc).current.collect()}
    assert out == {"a": ("p9", "manual_override"), "b": ("p2", "resolved")}


def test_names_resolve_exactly_or_not_at_all(spark):
    players = spark.createDataFrame([("1", "Ja'Marr Chase"), ("2", "Josh Allen"), ("3", "Josh Allen"), ("4", "Marvin Harrison Jr.")], "entity_id string, full_name string")
    names = spark.createDataFrame([("JaMarr Chase",), ("J. Chase",), ("Josh Allen",), ("Marvin Harrison",), ("Jamarr Chas",)], "name string")
    got = {r.name: (r.status, r.entity_id, r.candidate_count) for r in ID.resolve_names(names, players).collect()}
    assert got == {"JaMarr Chase": ("resolved", "1", 1), "J. Chase": ("resolved", "1", 1), "Josh Allen": ("ambiguous", None, 2),
                   "Marvin Harrison": ("resolved", "4", 1), "Jamarr Chas": ("unresolved", None, 0)}
    assert sorted(r.entity_id for r in ID.ambiguous_candidates(names, players).collect()) == ["2", "3"]


def test_contract_resolution_prefers_mappings_and_says_what_failed(spark):
    markets = spark.createDataFrame(
        [("t1", "KX-23SEP10DETKC", "Josh Allen: 75+ yards", None, None, "KXNFLRECYDS"), ("t2", "KX-23SEP10DETKC", "Jo Smith: 75+ yards", None, None, "KXNFLTD"),
         ("t3", "KX-BAD", "Josh Allen: over", None, 10.5, "KXNFLREC")],
        "ticker string, event_ticker string, title string, yes_sub_title string, floor_strike double, series string",
    )
    players = spark.createDataFrame([("2", "Josh Allen"), ("3", "Josh Allen")], "entity_id string, full_name string")
    games = spark.createDataFrame([("g", dt.datetime(2023, 9, 11, 0, 20), "KC", "DET")], "event_id string, kickoff_at timestamp, home_team string, away_team string")
    none = spark.createDataFrame([], "external_name string, entity_id string, status string, updated_at timestamp")
    rows = {r.ticker: r for r in ID.resolve_contracts(ID.parse_markets(markets), games, players, none).collect()}
    assert rows["t1"].resolution_status == "ambiguous" and rows["t1"].event_id == "g"
    assert rows["t2"].resolution_status == "unresolved" and "stat: series" in rows["t2"].resolution_note and "player: 0 are called" in rows["t2"].resolution_note
    assert "teams in KX-BAD" in rows["t3"].resolution_note
    over = ID.apply_overrides(none, spark.createDataFrame([("Josh Allen", "2", NOW)], "external_name string, entity_id string, updated_at timestamp"))
    again = {r.ticker: r for r in ID.resolve_contracts(ID.parse_markets(markets), games, players, over).collect()}
    assert again["t1"].resolution_status == "manual_override" and again["t1"].entity_id == "2" and again["t1"].resolution_note is None


def test_delisting_needs_a_complete_non_empty_discovery(spark):
    contracts = spark.createDataFrame([("a", "active", "S"), ("b", "active", "S"), ("c", "settled", "S")], "ticker string, status string, series string")
    seen = spark.createDataFrame([("a",)], "ticker string")
    run = lambda f, d: [r.ticker for r in MG.delist(contracts, seen, spark.createDataFrame([(f, d)], "failures int, discovered int"), ("S",)).collect()]
    assert run(0, 1) == ["b"] and run(1, 1) == [] and run(0, 0) == []


def test_contract_merge_settles_once(spark):
    m = "entity_id string, event_id string, stat_type string, threshold double, resolution_status string, resolution_note string"
    cur = spark.createDataFrame([("a", None, "g", "s", 1.5, "unresolved", "x", "active", None, AT, AT), ("b", "p", "g", "s", 1.5, "resolved", None, "active", None, AT, AT)],
                                f"ticker string, {m}, status string, close_time timestamp, first_seen_at timestamp, last_seen_at timestamp")
    inc = spark.createDataFrame([("a", "p", "g", "s", 1.5, "resolved", None, None), ("b", "q", "g", "s", 9.5, "resolved", None, None), ("c", "r", "g", "s", 2.5, "resolved", None, None)], f"ticker string, {m}, close_time timestamp")
    got = {r.ticker: r for r in MG.contract_merge(cur, inc, F.lit(NOW)).current.collect()}
    assert got["a"].entity_id == "p" and got["b"].entity_id == "p" and got["b"].threshold == 1.5 and got["c"].first_seen_at == NOW and got["b"].last_seen_at == NOW


def test_observations_unpivot_and_zone_contract(spark):
    inj = spark.createDataFrame([(1, 1, "KC", "Out", None, "2023-10-04T18:00:00+00:00"), (2, 1, "KC", "", "Limited", "2023-10-04T18:00:00")],
                                "entity_id long, event_id long, team string, report_status string, practice_status string, date_modified string")
    assert [(r.entity_id, r.context_type) for r in CX.injury_observations(inj).collect()] == [(1, "injury_designation")]
    with pytest.raises(CX.SchemaDrift):
        CX.require_zoned(inj)
    snaps = spark.createDataFrame([(1, 1, "KC", AT, 60.0, 0.8765, None, 0.0, float("nan"))], "entity_id long, event_id long, team string, kickoff_at timestamp, offense_snaps double, offense_pct double, defense_snaps double, defense_pct double, st_pct double")
    got = {r.context_type: float(r.numeric_value) for r in CX.snap_observations(snaps).collect()}
    assert got == {"snap_count_offense": 60.0, "snap_pct_offense": 0.876, "snap_pct_defense": 0.0}


def test_weather_classes(spark):
    ev = spark.createDataFrame([(1, 2023, AT, True, False, "KC"), (2, 2020, AT, False, True, "KC"), (3, 2023, AT, False, False, "XX"), (4, 2023, AT, False, False, "KC"), (5, 2020, AT, False, False, "KC")],
                               "event_id long, season int, kickoff_at timestamp, is_dome boolean, is_neutral_site boolean, home_team string")
    coords = spark.createDataFrame([("KC", 39.0, -94.5)], "team string, latitude double, longitude double")
    readings = spark.createDataFrame([(4, "src", 7.0, 18.0, 0.0)], "event_id long, reading_source string, temperature_c double, wind_kph double, precipitation_mm double")
    got = {r.event_id: (r.status, r.temperature_c is not None) for r in CX.weather_rows(ev, coords, readings).collect()}
    assert got == {1: ("dome", False), 2: ("unavailable", False), 3: ("unavailable", False), 4: ("observed", True), 5: ("request_failed", False)}


def test_stale_runs(spark):
    runs = spark.createDataFrame([("a", "running", NOW - dt.timedelta(hours=25), None, None), ("b", "running", NOW - dt.timedelta(hours=23), None, None)], "run_id string, status string, started_at timestamp, finished_at timestamp, error_message string")
    assert {r.run_id: r.status for r in MG.reap_stale_runs(runs, F.lit(NOW)).collect()} == {"a": "interrupted", "b": "running"}


def test_runs_are_folded_in_any_order(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [
        ("a", "ingest", "i1", "started", None, None, at(0), 1), ("a", "ingest", "i1", "finished", "failed", "x", at(1), 2), ("a", "ingest", "i1", "finished", "succeeded", None, at(2), 3),
        ("b", "ingest", "i1", "started", None, None, at(3), 4), ("b", "ingest", "i1", "finished", "failed", "y", at(4), 5),
        ("c", "ingest", "i2", "started", None, None, at(0), 6), ("d", "ingest", "i3", "started", None, None, at(40), 7), ("e", "ingest", "i4", "finished", "failed", None, at(1), 8),
        ("f", "other", "i1", "started", None, None, at(0), 9), ("f", "other", "i1", "finished", "failed", "z", at(47), 10),
    ]
    schema = "run_id string, category string, invocation_id string, kind string, status string, error_message string, at timestamp, seq long"
    want = {"a": ("succeeded", 2, 1), "c": ("interrupted", 1, 0), "d": ("running", 1, 0), "f": ("failed", 1, 0)}
    for given in (rows, rows[::-1], rows[5:] + rows[:5]):
        log = spark.createDataFrame(given, schema)
        runs = MG.fold_runs(log, F.lit(at(48)))
        assert {r.run_id: (r.status, r.deliveries, r.late_reports) for r in runs.collect()} == want
        assert sorted(r.seq for r in MG.ignored_reports(log, runs).collect()) == [5, 8]
    assert MG.fold_runs(spark.createDataFrame([], schema), F.lit(at(48))).count() == 0
