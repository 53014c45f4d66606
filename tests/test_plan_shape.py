"""The physical plans of the heavy operators: no cross joins, no Python, pruned scans."""

import pytest

from busloom.plans.catalog import all_queries

FOLDER = "/root/testdata/sf0.001"
HEAVY = """q6_quality_rollup g4_impute_departures s1_demand_bins s6_gap_types k3_headway_stats k13_yard_occupancy
k18_availability_before_gaps e13_feature_correlation b6_fold_sizes b8_historical_average v3_common_support io1_extract_trips
e6_autocorrelation e7_partial_autocorrelation e8_augmented_dickey_fuller""".split()


def plan_of(spark, name):
    df = all_queries()[name].run(spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", HEAVY)
def test_no_pairwise_joins_and_no_python(spark, name):
    plan = plan_of(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval", "InPandas"):
        assert bad not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(spark, "s1_demand_bins")
    assert "props" not in plan and "user_id" not in plan
