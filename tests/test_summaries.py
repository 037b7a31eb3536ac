"""Summaries are summed once, and scored batches and rounding equal their plain forms."""

import math
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal, localcontext

from pyspark.sql import functions as F

from cutline import constants as K
from cutline.functions import distributions as D
from cutline.functions import numbers as N
from cutline.operators import metrics as MT
from cutline.session import materialize
from cutline.sources import writers as W


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def printed(value, places):
    with localcontext(prec=60):
        return float(Decimal(repr(value)).quantize(Decimal(1).scaleb(-places - 12), ROUND_HALF_UP).quantize(Decimal(1).scaleb(-places), ROUND_HALF_EVEN))


def test_half_even_needs_no_text_and_equals_the_printed_form(spark):
    values = [0.0, -0.0, 0.5, 1.5, 2.5, -2.5, 0.125, 0.135, 1.005, 2.675, -0.004, 1e-9, 123456.785, 1e9 + 0.125, 3.3e15, -7.77777, 0.1 + 0.2, None]
    values += [(i * 0.37 + j * 1e-3) * (-1) ** i for i in range(60) for j in range(11)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for places in (2, 3, 6):
        got = {r.i: r.x for r in df.select("i", N.half_even(F.col("v"), places).alias("x")).collect()}
        want = [None if v is None else printed(v, places) for v in values]
        assert [got[i] for i in range(len(values))] == want
        assert not [g for g in got.values() if g == 0 and math.copysign(1, g) < 0]
    assert "rint" in plan_of(df.select(N.half_even(F.col("v"), 2).alias("x"))).lower()


def test_summaries_expand_sums_and_not_rows(spark):
    p = spark.createDataFrame(
        [("m", 2000, "e", True, True, 1.0, 1.0, 2.0, None, 3.0, 9.0), ("m", 2001, "e", False, False, 4.0, 16.0, None, None, 5.0, 25.0), ("k", 2001, "f", True, True, 2.0, 4.0, 1.0, 8.0, 0.0, 0.0)],
        "measure string, season int, era string, contract_like boolean, in_comparison_population boolean, abs_error double, sq_error double, "
        "baseline_season_avg_abs_error double, baseline_trailing5_abs_error double, abs_error_median double, sq_error_median double")
    got = {(r.population, r.axis, r.axis_key, r.block, r.series): (r.n, r.mae, r.rmse) for r in MT.error_metrics(p).collect()}
    assert got["all", "all", None, "modelOnly", "model"] == (3, 7 / 3, math.sqrt(7.0)) and got["all", "all", None, "comparison", "trailingFive"] == (1, 8.0, 8.0)
    assert got["all", "season", "2001", "comparison", "model"] == (1, 2.0, 2.0) and got["contract_like", "all", None, "pointEstimates", "median"] == (2, 1.5, math.sqrt(4.5))
    assert ("all", "stat_type", "m", "comparison", "trailingFive") not in got  # no rows, no zero
    t = spark.createDataFrame([(f"p{i % 5}", "m", 2000 + i % 3, "e", i % 10 / 10, i % 2 == 0, i % 4 == 0, i < 5, i < 5) for i in range(40)],
                              "prediction_id string, stat_type string, season int, era string, probability double, outcome boolean, contract_like boolean, leads boolean, leads_bin boolean")
    for df, copied in ((MT.error_metrics(p), "Expand"), (MT.calibration_bins(t), "Expand"), (MT.threshold_scores(t), "Generate")):
        plan = plan_of(df)
        for part in plan.split(copied)[1:]:
            assert "Aggregate" in part.split("Expand")[0], plan  # what is copied has been summed


def test_a_scored_batch_equals_its_parts(spark):
    rows = [(0, K.CONTINUOUS, 0.2, 1.0, 0.5, None, None, None, [0.0, 2.5, 9.0]), (1, K.COUNT, None, None, None, 4.0, 0.5, 3, [1.5, 0.5]), (2, K.COUNT, None, None, None, 2.5, 0.4, 6, [1.5]),
            (3, None, None, None, None, None, None, None, [1.0]), (4, K.COUNT, None, None, None, 0.0, 0.4, 2, [1.0]), (5, K.COUNT, None, None, None, 1e5, 0.5, 2, [99_000.5]), (6, K.CONTINUOUS, 1.0, 0.0, 1.0, None, None, None, [])]
    df = spark.createDataFrame(rows, "i int, family string, p_zero double, mu double, sigma double, r double, p double, cap int, t array<double>").coalesce(1)
    scored = df.withColumn("s", D.score_table("family", "p_zero", "mu", "sigma", "r", "p", "cap", "t"))
    got = {r.i: r.s for r in scored.collect()}
    parts = {r.i: r for r in df.select("i", D.zil_quantiles(F.col("p_zero"), F.col("mu"), F.col("sigma")).alias("zq"), D.nb_table(F.col("r"), F.col("p"), F.col("cap")).alias("nb")).collect()}
    assert got[0].pmf is None and all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got[0].quantiles, parts[0].zq)) and got[0].probabilities[0] == 1.0
    for i in (1, 2, 5):
        assert (got[i].pmf, got[i].quantiles) == (parts[i].nb.pmf, parts[i].nb.quantiles) and len(got[i].pmf) == rows[i][7] + 1
    assert (got[3].quantiles, got[3].probabilities, got[4].pmf, got[4].quantiles, got[4].probabilities) == (None,) * 5
    assert got[6].quantiles == [0.0] * len(K.QUANTILE_GRID) and got[6].probabilities == []
    tails = {(r.i, r.x): r.y for r in df.where("family = 'count'").select("i", "r", "p", F.explode("t").alias("x")).select("i", "x", D.nb_at_least(F.col("r"), F.col("p"), F.col("x")).alias("y")).collect()}
    assert [got[1].probabilities, got[2].probabilities, got[5].probabilities] == [[tails[1, 1.5], tails[1, 0.5]], [tails[2, 1.5]], [tails[5, 99_000.5]]]


def test_stages_and_datasets_are_stored_small(spark, tmp_path):
    df = spark.range(1000).select(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 32).alias("prediction_id"), (F.col("id") % 2).alias("season"))
    W.write_dataset(df, str(tmp_path), "predictions")
    stored = materialize(df, "ids")
    assert stored.exceptAll(df).isEmpty() and stored.exceptAll(spark.read.parquet(str(tmp_path / "predictions")).select(*df.columns)).isEmpty()
    for files in (stored.inputFiles(), spark.read.parquet(str(tmp_path / "predictions")).inputFiles()):
        assert files and all(f.endswith(".zstd.parquet") for f in files)
