"""Plan guards: registered queries run JVM-side (no Python UDF / pandas operators) and prune scans."""

import pytest

import __spark_entry__ as entry
from segcast.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")
# model queries run MLlib (JVM) but their fits are covered in test_forecast_models; ridge_scores is the
# one documented applyInPandas (one segment's weekly history per group)
SKIP = {"ridge_scores", "ensemble_scores", "feature_importance", "risk_forecast_panel", "interval_forecast_panel",
        "mean_forecast_panel", "factor_forecast_panel"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_no_python_in_plan(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in PYTHON_NODES), name


def test_scan_is_pruned(spark):
    plan = entry.queries()["weekly_rollup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "l_orderkey" in line)
    assert "l_partkey" not in scan and "l_tax" not in scan and "l_discount" not in scan


ONE_SCAN = {"lineitem": ["baseline_metrics", "dual_uncertainty", "blend_interval", "timeline_union", "segment_summary", "report_summary",
                         "recursive_forecast_naive", "kpi_delta"],
            "orders": ["selector_values", "top_segments", "event_profile", "monthly_counts_selections", "day_night_selections",
                       "top_segments_selections"]}


@pytest.mark.parametrize("fact, name", [(f, n) for f, names in ONE_SCAN.items() for n in names])
def test_facts_are_scanned_once(spark, fact, name):
    """Jobs run at construction (the stored panel) and the final adaptive plan together read the fact table once."""
    seen = []
    original = type(spark.read).parquet

    def counted(self, *paths, **kw):
        seen.extend(p for p in paths if p.endswith(f"{fact}.parquet"))
        return original(self, *paths, **kw)

    type(spark.read).parquet = counted
    try:
        df = QUERIES[name](spark, SF)
    finally:
        type(spark.read).parquet = original
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    in_plan = sum("FileScan parquet" in line and ("l_orderkey" in line or "o_orderkey" in line) for line in plan.splitlines())
    assert len(seen) == 1 and in_plan <= 1
