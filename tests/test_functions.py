import datetime as dt
import math
import uuid
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from cutline import constants as K
from cutline.functions import distributions as D
from cutline.functions import keys, normal, numbers as N, rows as RW, text as TX, times


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_normal_pair_matches_the_standard_library(spark):
    zs = [i / 7 for i in range(-60, 61)] + [-37.0, 8.3, 0.66]
    ps = [i / 997 for i in range(1, 997)] + [1e-12, 1 - 1e-9]
    nd = NormalDist()
    for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal.normal_cdf(F.col("z")).alias("c")).collect():
        assert abs(r.c - nd.cdf(r.z)) < 1e-12
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal.normal_ppf(F.col("p")).alias("c")).collect():
        assert abs(r.c - nd.inv_cdf(r.p)) < 1e-9
    assert one(spark, normal.normal_ppf(F.lit(1.0)))[0] is None


@pytest.mark.parametrize("p0,mu,sigma", [(0.0, 3.0, 0.5), (0.3, 4.1, 0.9), (1.0, 2.0, 0.35)])
def test_zil_monotone_and_consistent_with_quantiles(spark, p0, mu, sigma):
    par = (F.lit(p0), F.lit(mu), F.lit(sigma))
    row = one(spark, D.zil_quantiles(*par).alias("q"), *[D.zil_at_least(*par, F.lit(t)).alias(f"t{i}") for i, t in enumerate((-1.0, 0.0, 5.5, 50.5, 500.5))])
    probs = list(row)[1:]
    assert probs[:2] == [1.0, 1.0] and probs == sorted(probs, reverse=True)
    nd = NormalDist()
    for q, got in zip(K.QUANTILE_GRID, row.q):
        want = 0.0 if q <= p0 else math.exp(mu + sigma * nd.inv_cdf((q - p0) / (1 - p0)))
        assert got == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("mean,ratio", [(0.05, 1.05), (0.6, 2.0), (4.0, 1.3), (40.0, 6.0)])
def test_nb_sums_to_one_and_quantiles_pass_the_cap(spark, mean, ratio):
    fit = D.nb_fit(F.lit(mean), F.lit(mean * ratio))
    base = spark.range(1).select(fit["r"].alias("r"), fit["p"].alias("p")).select(
        "r", "p", D.nb_pmf(F.col("r"), F.col("p"), F.lit(4)).alias("pmf"), D.nb_quantiles(F.col("r"), F.col("p")).alias("q"),
        D.nb_table(F.col("r"), F.col("p"), F.lit(4)).alias("t"), D.nb_at_least(F.col("r"), F.col("p"), F.lit(9.5)).alias("beyond"),
    )
    row = base.select("*", D.nb_tail_mass(F.col("pmf")).alias("tail")).first()
    assert sum(row.pmf) + row.tail == pytest.approx(1.0, abs=1e-12)
    mass, reached, k, want, below = row.p**row.r, row.p**row.r, 0, [], 0.0
    grid = list(K.QUANTILE_GRID)
    terms = [mass]
    while grid:
        while grid and reached >= grid[0]:
            want.append(float(k))
            grid.pop(0)
        k += 1
        mass = mass * (row.r + k - 1) / k * (1 - row.p)
        terms.append(mass)
        reached += mass
    assert row.q == want and row.t.quantiles == want and row.t.pmf == pytest.approx(row.pmf, abs=1e-15)
    while len(terms) < 10:
        k += 1
        terms.append(terms[-1] * (row.r + k - 1) / k * (1 - row.p))
    assert row.beyond == pytest.approx(1 - sum(terms[:10]), abs=1e-12)


def test_unknown_kind_and_bad_parameters_score_null(spark):
    params = F.struct(F.lit(0.1).alias("p_zero"), F.lit(1.0).alias("mu"), F.lit(0.0).alias("sigma"), F.lit(None).cast("double").alias("r"), F.lit(None).cast("double").alias("p"))
    row = one(spark, D.at_least(F.lit("other"), params, F.lit(1.5)), D.at_least(F.lit(K.KIND_ZIL), params, F.lit(1.5)), D.at_least(F.lit(K.KIND_NB), params, F.lit(1.5)))
    assert list(row) == [None, None, None]


def test_confidence_is_ordered_first_match_wins(spark):
    rows = [(2, 0.1, "low"), (6, 2.01, "low"), (6, 1.45, "high"), (5, 1.0, "medium"), (9, 1.6, "medium")]
    df = spark.createDataFrame(rows, "n int, w double, want string")
    assert all(r.got == r.want for r in df.withColumn("got", D.confidence(F.lit(K.CONTINUOUS), F.col("n"), F.col("w"))).collect())


def test_publication_at_the_sharp_edges(spark):
    cases = [
        (dt.datetime(2023, 10, 1, 17, 0), dt.datetime(2023, 10, 2, 13, 0)),
        (dt.datetime(2023, 10, 2, 0, 20), dt.datetime(2023, 10, 2, 13, 0)),  # Sunday night: still Sunday in New York
        (dt.datetime(2023, 11, 5, 3, 30), dt.datetime(2023, 11, 5, 14, 0)),  # published after the clocks went back
        (dt.datetime(2024, 3, 10, 3, 30), dt.datetime(2024, 3, 10, 13, 0)),
    ]
    df = spark.createDataFrame(cases, "k timestamp, want timestamp").withColumn("got", times.published_at(F.col("k")))
    assert all(r.got == r.want for r in df.collect())


def test_clock_parsing(spark):
    row = one(
        spark, times.eastern_to_utc(F.lit("2023-09-10"), F.lit("13:00")), times.eastern_to_utc(F.lit("2023-12-10"), F.lit(None).cast("string")),
        times.eastern_to_utc(F.lit(None).cast("string"), F.lit("13:00")), times.observed_to_utc(F.lit("2023-10-04T18:00:00-04:00")),
        times.observed_to_utc(F.lit("2023-10-04T18:00:00")),
    )
    assert list(row) == [dt.datetime(2023, 9, 10, 17, 0), dt.datetime(2023, 12, 10, 5, 0), None, dt.datetime(2023, 10, 4, 22, 0), None]


def test_keys_and_rounding(spark):
    row = one(spark, keys.player_key(F.lit("00-0033873")), keys.event_key(F.lit("2023_01_DET_KC")), N.half_even(F.lit(2.675), 2), N.half_even(F.lit(0.125), 2),
              N.half_up_2(F.lit(-1.005)), N.book_side(F.lit(0.4)), N.book_side(F.lit(99.4)), N.book_side(F.lit(float("nan"))), N.mid_price(F.lit(40), F.lit(43)))
    ns = uuid.UUID(K.KEY_NAMESPACE)
    assert row[0] == str(uuid.uuid5(ns, "nflverse:player:00-0033873")) and row[1] == str(uuid.uuid5(ns, "nflverse:game:2023_01_DET_KC"))
    assert list(row)[2:] == [2.68, 0.12, -1.0, None, 99, None, 42]


def test_the_two_name_forms_differ(spark):
    row = one(spark, TX.ingest_name_tokens(F.lit("Ja'Marr Chase")), TX.market_name(F.lit("Ja'Marr Chase")), TX.ingest_name_tokens(F.lit("Odell Beckham Jr.")),
              TX.market_name(F.lit("José  Núñez III")), TX.ingest_name_tokens(F.lit("V")))
    assert list(row) == [["jamarr", "chase"], "ja marr chase", ["odell", "beckham"], "jose nunez", ["v"]]


def test_market_text(spark):
    rows = [
        ("Jaxon Smith-Njigba: 75+", None, "Jaxon Smith-Njigba", 75.0), (None, "Josh Allen 250+ passing yards", "Josh Allen", 250.0),
        ("Receiving: 20+", "Yards 20+", None, 20.0), (None, "nothing here", None, None),
    ]
    df = spark.createDataFrame(rows, "s string, t string, n string, x double")
    got = df.select("n", "x", TX.market_player_name(F.col("s"), F.col("t")).alias("gn"), TX.market_threshold(F.lit(None).cast("double"), F.col("s"), F.col("t")).alias("gx")).collect()
    assert all(r.n == r.gn and r.x == r.gx for r in got)
    assert one(spark, TX.market_threshold(F.lit(74.5), F.lit("75+"), F.lit(None).cast("string")))[0] == 74.5


def test_event_ticker_needs_exactly_one_split(spark):
    df = spark.createDataFrame([("KX-26FEB08SEANE",), ("KX-26FEB08LALAC",), ("KX-26XXX08KCDET",), ("KX-26FEB08QQQQ",), ("KX",)], "t string")
    got = [(r.e.game_date, r.e.away_code, r.e.home_code) for r in df.select(TX.event_ticker_parts(F.col("t")).alias("e")).collect()]
    day = dt.date(2026, 2, 8)
    assert got == [(day, "SEA", "NE"), (day, "LA", "LAC"), (None, "KC", "DET"), (day, None, None), (None, None, None)]


def test_redaction_runs_structure_first(spark):
    row = one(spark, TX.redact_error(F.lit("at postgresql://u:postgres@h/db and sekret"), ("postgres", "sekret")))
    assert "u:postgres" not in row[0] and "sekret" not in row[0] and "://<redacted>@h" in row[0]


def test_roles_decide_absence(spark):
    # position, attempts, carries, targets, passing, rushing, receiving
    rows = [("QB", 30, 2, 0, True, True, False), ("RB", 0, 9, 0, False, True, True), ("WR", 0, 0, 6, False, False, True), ("TE", 0, 1, 0, False, True, True), (None, 0, 0, 0, False, False, False)]
    df = spark.createDataFrame(rows, "pos string, a int, c int, t int, p boolean, ru boolean, re boolean")
    played = RW.participation(F.col("a"), F.col("c"), F.col("t"), F.col("pos"))
    for r in df.select("*", *[v.alias(f"got_{k}") for k, v in played.items()]).collect():
        assert (r.got_passing, r.got_rushing, r.got_receiving) == (r.p, r.ru, r.re)


def test_stat_line_values_keep_genuine_zeros(spark):
    cols = {s: 0.0 for _, s, _ in K.STAT_COLUMN_SOURCES}
    df = spark.createDataFrame([{**cols, "carries": 5.0, "rushing_yards": 12.34, "receiving_yards": 0.0}], schema=", ".join(f"{c} double" for c in cols))
    row = df.select(*[v.alias(k) for k, v in RW.stat_line_values(F.lit("RB")).items()]).first()
    assert row.passing_yards is None and float(row.rushing_yards) == 12.3 and float(row.receiving_yards) == 0.0 and row.targets == 0


def test_hourly_reading(spark):
    df = spark.createDataFrame([(["2023-10-01T17:00", "2023-10-01T18:00"], [7.0, 8.0], dt.datetime(2023, 10, 1, 18, 25))], "h array<string>, v array<double>, k timestamp")
    assert df.select(RW.hourly_reading(F.col("h"), F.col("v"), F.col("k"))).first()[0] == 8.0
    assert df.select(RW.hourly_reading(F.col("h"), F.col("v"), F.col("k") + F.expr("INTERVAL 3 HOURS"))).first()[0] is None


def test_large_and_bad_counts(spark):
    """Means far past underflow against lgamma; rows that are no distribution are NULL and end nothing."""
    import math

    def mass(k, r, p):
        return math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(p) + k * math.log1p(-p))

    rows = [(800.0 / 0.05, 1 / 1.05, 801.0), (1e5 / 4.0, 1 / 5.0, 1e5 + 700), (0.5, 1e-4, 9e3), (2.0, 0.4, 3.0), (-1.0, 0.5, 1.0), (None, 0.5, 1.0), (3.0, 1.5, 1.0)]
    base = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r double, p double, t double").repartition(2)
    found = {x.i: x for x in base.select("i", D.nb_at_least(F.col("r"), F.col("p"), F.col("t")).alias("tail"), D.nb_table(F.col("r"), F.col("p"), F.lit(900)).alias("nb")).collect()}
    for i, (r, p, t) in enumerate(rows[:4]):
        want = 1 - sum(mass(k, r, p) for k in range(int(t))) if t < 2e4 else sum(mass(k, r, p) for k in range(int(t), int(t) + 40_000))
        assert abs(found[i].tail - want) < 1e-7
        assert abs(found[i].nb.pmf[800] - mass(800, r, p)) < 1e-9
        q50 = found[i].nb.quantiles[3]
        assert q50 == int(q50) and abs(q50 - r * (1 - p) / p) < 2 * math.sqrt(r * (1 - p)) / p + 1
    for i in (4, 5, 6):
        assert found[i].tail is None and found[i].nb.pmf is None


def test_count_tails_have_no_limit():
    """Against sums of exact rationals in logarithms: shapes from 0.001, thresholds of a million, means beyond a billion."""
    import numpy as np
    from math import exp, fsum, lgamma, log, log1p

    from cutline.functions import distributions as D

    def tail(r, p, k):
        mass = exp(lgamma(k + r) - lgamma(r) - lgamma(k + 1) + r * log(p) + k * log1p(-p))
        out, j = [], k
        while mass > 1e-18 * max(fsum(out[:1]), 1e-300) and j < k + int(60 / p):
            out.append(mass)
            mass *= (j + r) / (j + 1) * (1 - p)
            j += 1
        return fsum(out)

    rows = [(0.001, 8e-5, 30_000), (0.01, 3e-4, 40_000), (0.001, 4e-5, 100_000), (3.0, 1e-4, 20_000), (5.0, 1e-4, 60_000), (0.5, 0.3, 3), (40.0, 0.01, 4_500), (2.0, 1.0, 1)]
    r, p, k = (np.array(x, float) for x in zip(*rows))
    got = D.nb_upper(r, p, k)
    for (a, b, c), g in zip(rows, got):
        want = tail(a, b, c) if b < 1 else 0.0
        assert abs(g - want) < 1e-9 and (want < 1e-250 or abs(g - want) < 1e-6 * want), (a, b, c, g, want)
    big = D.nb_upper(np.array([1e6, 1.0]), np.array([1e-4, 1e-9]), np.array([1e10, 1e9]))
    assert abs(big[0] - 0.46) < 1e-3 and abs(big[1] - exp(1e9 * log1p(-1e-9))) < 1e-9  # a geometric tail in closed form
    q = D._searched(np.array([1.0]), np.array([1e-7]), np.array([0.05, 0.5, 0.95]))[0]
    for level, count in zip((0.05, 0.5, 0.95), q):
        below = lambda n: -np.expm1((n + 1) * log1p(-1e-7))
        assert below(count) >= level - 1e-12 and below(count - 1) < level
