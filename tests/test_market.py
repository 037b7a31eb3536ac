import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cutline.functions import market as M
from cutline.operators import market as MK
from cutline.operators import metrics as MT

NOW = dt.datetime(2024, 1, 10, 12)


def test_edge_decision_table(spark):
    rows = [
        (0.6, "high", 50, 45, "yes", 10.0, 10.0, True), (0.4, "medium", 45, 50, "no", 10.0, 7.0, True), (0.5, "low", 45, 45, "yes", 5.0, 2.0, False),
        (None, "high", 50, 45, None, None, None, False), (0.6, None, 50, 45, None, None, None, False), (0.6, "high", None, None, None, None, None, False), (0.9, "high", None, 30, "no", -20.0, -20.0, False),
    ]
    df = spark.createDataFrame(rows, "p double, c string, y int, n int, side string, e double, a double, rec boolean")
    got = df.select("side", "e", "a", "rec", *[v.alias(f"got_{k}") for k, v in M.edge(F.col("p"), F.col("c"), F.col("y"), F.col("n")).items()])
    for r in got.collect():
        assert (r.got_side, r.got_edge_points, r.got_adjusted_edge, r.got_is_recommended) == (r.side, r.e, r.a, r.rec)


def test_signal_precedence(spark):
    ago = lambda h: NOW - dt.timedelta(hours=h)
    rows = [
        (False, "failed", ago(1), None, "not_expected"), (True, "running", ago(1), None, "running"), (True, "running", ago(3), ago(1), "failed"),
        (True, "failed", ago(1), ago(2), "failed"), (True, None, None, None, "never_run"), (True, "succeeded", ago(30), ago(27), "late"), (True, "succeeded", ago(3), ago(2), "ok"),
    ]
    df = spark.createDataFrame(rows, "x boolean, s string, t timestamp, ok timestamp, want string")
    state = M.signal_state(F.col("x"), F.col("s"), F.col("t"), F.col("ok"), F.lit(26 * 60), F.lit(NOW))
    assert all(r.got == r.want for r in df.withColumn("got", state).collect())


def test_staleness_is_strict_and_null_without_projection(spark):
    rows = [(NOW, NOW, False), (NOW, NOW + dt.timedelta(seconds=1), True), (NOW, None, False), (None, NOW, None)]
    df = spark.createDataFrame(rows, "c timestamp, f timestamp, want boolean")
    s = M.staleness(F.lit(NOW + dt.timedelta(minutes=90)), F.col("c"), F.col("f"), F.lit(NOW))
    for r in df.select("want", "c", s["is_stale"].alias("s"), s["predates_inactives"].alias("p")).collect():
        assert r.s == r.want and r.p == (True if r.c else None)


def books(seed, n=300):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        k = 1 if rnd.random() < 0.6 else rnd.randrange(2, 5)
        ask = rnd.choice([40, 40, 40, 41, None])
        out.append((k, i, NOW + dt.timedelta(minutes=rnd.randrange(0, 4000, 5)), 38, ask, 50, 60))
    return out


def keep(rows, minutes):
    last, out = {}, []
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        p = last.get(r[0])
        if p is None or p[3:] != r[3:] or r[2] - p[2] >= dt.timedelta(minutes=minutes):
            last[r[0]] = r
            out.append(r[1])
    return sorted(out)


BOOK = "contract_id long, observation_id long, observed_at timestamp, yes_bid int, yes_ask int, no_bid int, no_ask int"


@pytest.mark.parametrize("seed,minutes,walked", [(1, 15, 100_000), (2, 60, 100_000), (2, 60, 4)])
def test_compaction_matches_a_sequential_recorder(spark, monkeypatch, seed, minutes, walked):
    monkeypatch.setattr(MK, "WALKED_ROWS", walked)  # longer runs are marked by doubling
    rows = books(seed)
    got = MK.compact_prices(spark.createDataFrame(rows, BOOK), minutes, bucket_seconds=6 * 3600)
    assert sorted(r.observation_id for r in got.collect()) == keep(rows, minutes)


def test_transitions_count_stored_snapshots(spark):
    cols = "contract_id long, at timestamp, seq long, is_recommended boolean, side string"
    t = lambda i: NOW + dt.timedelta(minutes=i)
    states = [(1, t(0), 0, False, "yes"), (1, t(1), 1, True, "yes"), (1, t(2), 2, True, "yes"), (1, t(3), 3, True, "no"), (1, t(4), 4, False, None), (1, t(5), 5, False, "yes"), (2, t(1), 6, False, None)]
    got = [(r.seq, r.trigger) for r in MK.transitions(spark.createDataFrame(states, cols)).orderBy("seq").collect()]
    assert got == [(1, "appeared"), (3, "state_changed"), (4, "state_changed")]
    stored = spark.createDataFrame([(2, t(0), 0, True, "yes")], cols)
    assert [(r.seq, r.trigger) for r in MK.transitions(spark.createDataFrame(states[-1:], cols), stored).collect()] == [(6, "state_changed")]


def test_decisions_close_freeze_and_supersede(spark):
    contracts = spark.createDataFrame([(1, "A", "p", "g", "s", 10.5, "active", "resolved", None), (2, "B", "p", "old", "s", 10.5, "active", "resolved", None), (3, "C", None, None, None, None, "delisted", "unresolved", None)],
                                      "contract_id long, ticker string, entity_id string, event_id string, stat_type string, threshold double, status string, resolution_status string, close_time timestamp")
    events = spark.createDataFrame([("g", NOW + dt.timedelta(hours=3), "scheduled"), ("old", NOW - dt.timedelta(hours=3), "scheduled")], "event_id string, kickoff_at timestamp, status string")
    params = "struct<p_zero:double,mu:double,sigma:double,r:double,p:double>"
    proj = spark.createDataFrame([("pr", "p", "g", "s", "zero_inflated_lognormal", (0.0, 3.0, 0.5, None, None), "high", NOW, NOW)],
                                 f"projection_id string, entity_id string, event_id string, stat_type string, distribution_kind string, params {params}, confidence string, computed_at timestamp, information_cutoff timestamp")
    book = spark.createDataFrame([(1, 7, NOW, 40, 42, 57, 60)], BOOK)
    ask = "decision_id long, contract_id long, disposition string, decided_at timestamp"
    stored = spark.createDataFrame([(1, 1, "watch", NOW - dt.timedelta(hours=1))], ask)
    asked = spark.createDataFrame([(10, 1, "watch", NOW), (11, 1, "take", NOW + dt.timedelta(minutes=1)), (12, 2, "take", NOW), (13, 3, "take", NOW), (14, 9, "take", NOW)], ask)
    rows, refused = MK.record_decisions(asked, contracts, events, stored, proj, book)
    (row,) = rows.collect()
    assert (row.decision_id, row.supersedes_decision_id, row.side, row.ask_cents, row.projection_id, row.observation_id) == (11, 1, "yes", 42, "pr", 7)
    assert {r.decision_id: r.refusal for r in refused.collect()} == {12: "closed", 13: "closed", 14: "no_such_contract"}


def test_bins_are_half_open_with_a_closed_last_one(spark):
    rows = [(k / 10, min(k, 9)) for k in range(11)] + [(0.099999, 0), (0.999999, 9)]
    df = spark.createDataFrame(rows, "p double, want int")
    assert all(r.got == r.want for r in df.withColumn("got", MT.bin_of(F.col("p"))).collect())


def test_a_decision_freezes_what_its_instant_knew(spark):
    hour = dt.timedelta(hours=1)
    contracts = spark.createDataFrame(
        [(1, 7, 70, "m", 50.0, "active", None), (2, 7, 71, "m", 50.0, "active", None), (3, 7, None, "m", 50.0, "delisted", None), (4, 7, None, "m", 50.0, "active", NOW), (5, None, None, None, None, "active", None)],
        "contract_id long, entity_id long, event_id long, stat_type string, threshold double, status string, close_time timestamp")
    events = spark.createDataFrame([(70, NOW + 9 * hour, "scheduled"), (71, NOW - hour, "scheduled")], "event_id long, kickoff_at timestamp, status string")
    stored = spark.createDataFrame([(100, 1, "pass", NOW - 9 * hour)], "decision_id long, contract_id long, disposition string, decided_at timestamp")
    asked = spark.createDataFrame(
        [(1, 1, "take", NOW), (2, 1, "take", NOW + hour), (3, 1, "pass", NOW + 2 * hour), (4, 2, "take", NOW), (5, 3, "take", NOW), (6, 4, "take", NOW), (7, 4, "take", NOW - hour), (8, 9, "take", NOW), (9, 5, "take", NOW), (10, 1, "take", NOW + 10 * hour)],
        "decision_id long, contract_id long, disposition string, decided_at timestamp")
    zil = "zero_inflated_lognormal"
    models = spark.createDataFrame(
        [("p1", 7, 70, "m", zil, {"p_zero": 0.0, "mu": 5.0, "sigma": 0.5}, "high", NOW - hour, NOW - hour), ("p2", 7, 70, "m", zil, {"p_zero": 0.9, "mu": 1.0, "sigma": 0.5}, "low", NOW + hour, NOW + hour)],
        "projection_id string, entity_id long, event_id long, stat_type string, distribution_kind string, params map<string,double>, confidence string, computed_at timestamp, information_cutoff timestamp")
    kind = models.select("projection_id", "entity_id", "event_id", "stat_type", "distribution_kind", F.struct(*[F.col("params")[k].alias(k) for k in ("p_zero", "mu", "sigma")], F.lit(None).cast("double").alias("r"), F.lit(None).cast("double").alias("p")).alias("params"), "confidence", "computed_at", "information_cutoff")
    book = spark.createDataFrame([(1, 11, NOW - hour, 40, 42, 57, 60), (1, 12, NOW + hour, 80, 82, 17, 20)], BOOK)
    got = {r.decision_id: r for r in MK.decision_log(asked, contracts, events, stored, kind, book).collect()}
    assert {k: r.outcome for k, r in got.items()} == {1: "recorded", 2: "unchanged", 3: "recorded", 4: "event_closed", 5: "market_closed", 6: "market_closed", 7: "recorded", 8: "no_such_contract", 9: "recorded", 10: "event_closed"}
    assert (got[1].supersedes_decision_id, got[1].projection_id, got[1].observation_id, got[1].side) == (100, "p1", 11, "yes")
    assert (got[3].supersedes_decision_id, got[3].projection_id, got[3].observation_id, got[3].side) == (1, "p2", 12, "no")
    assert got[7].supersedes_decision_id is None and got[9].model_probability is None and got[2].projection_id is None
