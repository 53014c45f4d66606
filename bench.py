"""Times the headline queries; prints one JSON line.

Each query runs twice on a warm session; the better run counts, and the first is kept
as ``cold``.  Stage tables are built anew for every run, inside its time.  Results are consumed by a no-op sink, so that all rows are computed.
"""

from __future__ import annotations

import json
import os
import time

from busloom.plans.catalog import all_queries
from busloom.plans.stages import forget
from busloom.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "q6_quality_rollup",
    "g4_impute_departures",
    "t2_resolve_trip_ends",
    "s1_demand_bins",
    "s6_gap_types",
    "k3_headway_stats",
    "k13_yard_occupancy",
    "f2_lags",
    "b8_historical_average",
    "v3_common_support",
    "b12_backtest_summary",
    "e13_feature_correlation",
    "k26_kpi_table",
    "t3_resume_trip_ends",
    "p1_pipeline",
    "s1_incremental_bins",
    "g2_many_fences",
    "b13_tree_forecast",
)


def seconds(spark, query) -> float:
    forget()
    start = time.perf_counter()
    query.run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, int(CPUS) if CPUS.isdigit() else 8)
    known = all_queries()
    spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    best, cold = {}, {}
    for name in HEADLINE:
        runs = [seconds(spark, known[name]) for _ in range(2)]
        cold[name], best[name] = round(runs[0], 3), round(min(runs), 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(best.values()), 3), "unit": "sec", "queries": best, "cold": cold,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "cpus": CPUS}))
    spark.stop()


if __name__ == "__main__":
    main()
