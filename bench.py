"""Bench: run the headline queries at $BENCH_SF_DIR (default sf0.1) on local[$BENCH_CPUS]
and print ONE JSON line with per-query wall seconds. Each query is fully executed
(noop sink), so every stage and shuffle runs."""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "weather_daily", "metar_daily", "airport_month_stats", "flights_weather", "sequences", "cascade_events",
    "cascade_propagation", "cascade_airport_days", "greedy_assignment", "pair_features", "risk_scores",
    "impact_by_k", "baseline_comparison", "avoid_list", "swap_recommendations", "seasonal_summary",
    "case_study_summary", "sequences_enriched", "auc_roc", "temporal_split", "ingest_flights", "metar_daily_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from hubrisk.session import build_session
    from hubrisk.plans.registry import QUERIES

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    if not spark.conf.get("spark.checkpoint.dir", None):  # a single-machine run may use its own folder
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hubrisk-bench-"))
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up
    times, rows = {}, {}
    for key in HEADLINE:
        t0 = time.time()
        df = QUERIES[key](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - t0, 3)
        del df
        gc.collect()  # drop Python-side handles so Spark's cleaner can release shuffles and broadcasts
        print(f"{key}: {times[key]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
