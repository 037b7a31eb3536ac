"""Headline queries at one scale; prints a single JSON line.

Each query writes its whole result to the noop sink. The stored corpus and the
stored run are steps of their own, because a deployment builds them once.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
QUERIES = (
    "ew_form", "season_avg_baseline", "walk_forward_prior", "backtest_predictions", "candidate_universe", "error_grouping_sets",
    "calibration_bins", "brier_logloss", "correction_merge", "schedule_revision_merge", "name_resolution", "contract_resolution",
    "latest_price", "price_change_heartbeat", "recommendation_transitions", "slate", "staleness", "leakage_hidden_rows", "content_digest",
    "stream_price_compaction",
)


def main() -> None:
    from cutline import workload
    from cutline.session import build_session
    from cutline.workload import model_queries, tables

    spark = build_session("bench", os.environ.get("BENCH_CPUS"))
    known = workload.queries()
    seconds: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    timed("build_corpus", lambda: tables.corpus(spark, SF_DIR))
    timed("build_run", lambda: model_queries.stored_run(spark, SF_DIR))
    for name in QUERIES:
        timed(name, lambda: known[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    candidates = tables.corpus(spark, SF_DIR).targets.count()
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "backtest_candidates": candidates,
        "backtest_candidates_per_sec": round(candidates / seconds["backtest_predictions"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
