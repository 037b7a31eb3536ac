"""As-of reads against brute force, leakage, and partitioning invariance."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from cutline import constants as K
from cutline.operators import bitemporal as B
from cutline.operators import history as H
from cutline.operators import priors as P

T0 = dt.datetime(2020, 9, 1, 17)
LINE = "entity_id long, event_id long, measure string, season int, team string, position string, valid_at timestamp, published_at timestamp, value double"
CORR = "entity_id long, event_id long, measure string, version int, known_at timestamp, has_prior boolean, prior_value double"


def corpus(seed=1, n=160):
    rnd = random.Random(seed)
    lines, corr = [], []
    for i in range(n):
        entity = 1 if rnd.random() < 0.55 else rnd.randrange(2, 8)  # one hot entity
        at = T0 + dt.timedelta(days=rnd.randrange(400), hours=rnd.randrange(3))
        season = at.year
        value = rnd.choice([None, 0.0, -2.0, float(rnd.randrange(1, 90)), float(rnd.randrange(1, 90))])
        lines.append((entity, i, "m", season, f"T{rnd.randrange(3)}", "WR", at, at + dt.timedelta(hours=16), value))
        for v in range(rnd.choice([0, 0, 1, 3])):
            corr.append((entity, i, "m", v + 2, at + dt.timedelta(days=5 + 40 * v + rnd.randrange(30)), rnd.random() < 0.85, rnd.choice([None, 7.0, 33.0])))
    return lines, corr


def value_at(line, corr, cutoff):
    later = sorted((c for c in corr if c[1] == line[1] and c[4] > cutoff), key=lambda c: (c[4], c[3]))
    return later[0][6] if later and later[0][5] else line[8]


def brute(target, lines, corr, season):
    _, entity, _, valid, cutoff = target
    seen = sorted((l[6], l[1], l) for l in lines if l[0] == entity and l[6] < valid and l[7] <= cutoff)
    kept = [(l, value_at(l, corr, cutoff)) for _, _, l in seen]
    kept = [(l, v) for l, v in kept if v is not None]
    mine = [v for l, v in kept if l[3] == season]
    return [(l[1], v) for l, v in kept[-8:]], len(kept), (sum(mine) / len(mine) if mine else None), (kept[-1][0][4] if kept else None)


def frames(spark, lines, corr):
    return B.value_versions(spark.createDataFrame(lines, LINE), spark.createDataFrame(corr, CORR))


def targets_of(spark, lines):
    rows = [(f"t{l[1]}", l[0], "m", l[6], l[6] - dt.timedelta(minutes=90), l[3]) for l in lines]
    rows.append(("nobody", 999, "m", T0, T0 - dt.timedelta(hours=2), 2020))
    return rows, spark.createDataFrame(rows, "target_id string, entity_id long, measure string, valid_at timestamp, cutoff timestamp, season int")


@pytest.mark.parametrize("seed,seconds", [(1, 30 * 86400), (2, 86400), (3, 7 * 86400)])
def test_window_matches_brute_force(spark, seed, seconds):
    lines, corr = corpus(seed)
    rows, targets = targets_of(spark, lines)
    got = {r.target_id: r for r in H.eligible_history_rows(targets, frames(spark, lines, corr), seconds).collect()}
    assert len(got) == len(rows)
    for t in rows:
        window, n, avg, team = brute(t[:5], lines, corr, t[5])
        r = got[t[0]]
        assert [(x.event_id, x.value) for x in r.window] == window
        assert (r.n_eff, r.last_team) == (n, team)
        assert (r.season_average is None) == (avg is None) and (avg is None or abs(r.season_average - avg) < 1e-6)


def test_late_facts_and_corrections_cannot_move_an_earlier_answer(spark):
    lines, corr = corpus(4)
    cutoff = T0 + dt.timedelta(days=200)
    asked = [(f"t{e}", e, "m", cutoff + dt.timedelta(hours=2), cutoff, cutoff.year) for e in range(1, 8)]
    targets = spark.createDataFrame(asked, "target_id string, entity_id long, measure string, valid_at timestamp, cutoff timestamp, season int")
    read = lambda ls, cs: sorted(map(str, H.eligible_history(targets, frames(spark, ls, cs)).collect()))
    full = read(lines, corr)
    kept = [l for l in lines if l[7] <= cutoff]
    assert read(kept, corr) == full
    later = [(1, 10_000, "m", 2021, "T1", "WR", cutoff + dt.timedelta(days=1), cutoff + dt.timedelta(days=2), 500.0)]
    # The newest line the cutoff can see is corrected after it: nothing moves.
    visible = max((l for l in kept if l[0] == 1 and l[8] is not None and not any(c[1] == l[1] for c in corr)), key=lambda l: l[6])
    changed = [(*l[:8], 999.0) if l is visible else l for l in lines]
    fix = [(1, visible[1], "m", 2, cutoff + dt.timedelta(days=3), True, visible[8])]
    assert read(changed + later, corr + fix) == full


def test_priors_ignore_their_own_and_later_seasons(spark):
    lines, corr = corpus(5)
    v = frames(spark, lines, corr)
    req = spark.createDataFrame([(2021, "m", "WR", dt.datetime(2021, 1, 20))], "season int, measure string, position string, prior_cutoff timestamp")
    full = P.walk_forward_priors(v, req).first()
    early = P.walk_forward_priors(frames(spark, [l for l in lines if l[3] < 2021], corr), req).first()
    assert full == early and full.fitted_from_seasons == [2020]
    values = [x for x in (value_at(l, corr, dt.datetime(2021, 1, 20)) for l in lines if l[3] < 2021 and l[7] <= dt.datetime(2021, 1, 20)) if x is not None]
    assert full.sample_games == len(values) and abs(full.mean - sum(values) / len(values)) < 1e-9
    assert abs(full.p_zero - sum(x <= 0 for x in values) / len(values)) < 1e-12


@pytest.mark.parametrize("values,want", [([0.0, -1.0], (1.0, 0.0, 0.35)), ([5.0, 0.0], (0.5, 1.6094379124341003, 0.35))])
def test_degenerate_moments(spark, values, want):
    df = spark.createDataFrame([("a", v) for v in values], "k string, value double")
    r = P.population_moments(df, ["k"]).first()
    assert (r.p_zero, round(r.mu, 9), r.sigma) == (want[0], round(want[1], 9), want[2])


def test_candidates_follow_the_last_team(spark):
    lines, corr = corpus(6)
    v = frames(spark, lines, corr)
    games = [(900 + i, 2020 + (i > 12), T0 + dt.timedelta(days=10 * i, hours=1), T0 + dt.timedelta(days=10 * i), "T0", "T1") for i in range(1, 40)]
    games = [(g[0], g[2].year, *g[2:]) for g in games]
    df = spark.createDataFrame(games, "event_id long, season int, valid_at timestamp, cutoff timestamp, home_team string, away_team string")
    rows = [(r.event_id, r.entity_id) for r in H.candidate_universe(df, v).collect()]
    got = set(rows)
    assert len(rows) == len(got)
    want = set()
    for g in games:
        for e in {l[0] for l in lines}:
            seen = sorted((l[6], l[1], l) for l in lines if l[0] == e and l[7] <= g[3] and value_at(l, corr, g[3]) is not None)
            if seen and seen[-1][2][4] in ("T0", "T1") and seen[-1][2][3] in (g[1], g[1] - 1):
                want.add((g[0], e))
    assert got == want


def test_snapshot_without_the_key_keeps_the_line_value(spark):
    df = spark.createDataFrame([(1, {"a": 5.0})], "id int, prior_values map<string,double>")
    got = {r.measure: (r.has_prior, r.prior_value) for r in B.corrections_to_long(df, ["id"], ["a", "b"]).collect()}
    assert got == {"a": (True, 5.0), "b": (False, None)}


@pytest.mark.parametrize("seed,n", [(1, 160), (7, 700)])
def test_whole_streams_match_brute_force(spark, seed, n):
    """One shuffle by stream gives the windows, totals and facts of the bucketed reads, on streams of many blocks too."""
    lines, corr = corpus(seed, n)
    rows, targets = targets_of(spark, lines)
    targets = targets.withColumn("event_id", F.expr("try_cast(substring(target_id, 2) as bigint)"))
    facts = spark.createDataFrame([(l[0], l[1], "m", float(l[1])) for l in lines if l[1] % 2], "entity_id long, event_id long, measure string, actual double")
    got = {r.target_id: r for r in H.with_history(targets, frames(spark, lines, corr), facts).collect()}
    assert len(got) == len(rows)
    for t in rows:
        window, size, avg, team = brute(t[:5], lines, corr, t[5])
        r = got[t[0]]
        assert [(x.event_id, x.value) for x in r.window] == window and (r.n_eff, r.last_team) == (size, team)
        assert (r.season_average is None) == (avg is None) and (avg is None or abs(r.season_average - avg) < 1e-6)
        assert r.actual == (float(t[0][1:]) if t[0] != "nobody" and int(t[0][1:]) % 2 else None)


def test_form_features_are_those_of_each_window_alone(spark):
    """One Arrow pass over a batch gives each window's own sums, oldest first; nothing is interpreted element by element."""
    rnd, nan = random.Random(5), float("nan")
    windows = [[], [0.0], [7.0], [-2.0, 0.0], [nan, 3.0], *[[rnd.choice([0.0, -2.0, rnd.random() * 90]) for _ in range(rnd.randrange(12))] for _ in range(300)]]
    at = lambda i: T0 + dt.timedelta(days=i * 100)
    rows = [(i, [(at(j), j, at(j).year, "T", v, at(j), None) for j, v in enumerate(w)]) for i, w in enumerate(windows)]
    df = spark.createDataFrame(rows, "i int, window array<struct<valid_at timestamp, event_id int, season int, team string, value double, visible_from timestamp, visible_to timestamp>>")
    form = H.form_features(df)
    assert "lambdafunction" not in form._jdf.queryExecution().optimizedPlan().toString()
    for r in form.collect():
        w, n = windows[r.i], len(windows[r.i])
        assert r.window_n == n and r.crosses_season == (len({at(j).year for j in range(n)}) > 1)
        if not n:
            assert (r.ew_mean, r.ew_zero, r.zero_rate, r.ew_log_mean, r.log_sigma, r.window_variance, r.trailing_five, r.last_team) == (None,) * 8
            continue
        if any(map(math.isnan, w)):
            assert math.isnan(r.ew_mean) and math.isnan(r.trailing_five) and r.ew_zero == 0.0
            continue
        weight = [0.5 ** ((n - 1 - j) / 4.0) for j in range(n)]
        logs = [(math.log(v), x) for v, x in zip(w, weight) if v > 0]
        mean = sum(w) / n
        log_mean = sum(l for l, _ in logs) / len(logs) if logs else None
        want = {
            "ew_mean": sum(x * v for v, x in zip(w, weight)) / sum(weight), "ew_zero": sum(x for v, x in zip(w, weight) if v <= 0) / sum(weight),
            "zero_rate": w.count(0.0) / n, "ew_log_mean": sum(l * x for l, x in logs) / sum(x for _, x in logs) if logs else 0.0,
            "log_sigma": max(math.sqrt(sum((l - log_mean) ** 2 for l, _ in logs) / (len(logs) - 1)), K.SIGMA_FLOOR) if len(logs) > 1 else K.SIGMA_FLOOR,
            "window_variance": sum((v - mean) ** 2 for v in w) / (n - 1) if n > 1 else mean * K.COUNT_MIN_DISPERSION, "trailing_five": sum(w[-5:]) / len(w[-5:]),
        }
        assert {c: r[c] for c in want} == pytest.approx(want, rel=1e-12, abs=1e-12), w
