"""Guards on physical plan shape: properties the design relies on at scale."""
import re

import pytest

import __spark_entry__ as entry

from .conftest import SF_SMALL

PIPELINES = ["Q1", "Q2", "Q2_post", "Q3", "Q4", "Q5", "Q6", "Q7", "Q8"]


def _plan(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PIPELINES)
def test_no_python_evaluation_in_plans(spark, name):
    plan = _plan(spark, name)
    for op in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"):
        assert op not in plan, f"{name} evaluates Python ({op})"


@pytest.mark.parametrize("name", ["Q2", "Q2_post", "Q3", "Q4", "W1", "W2", "W3", "W4", "W5"])
def test_latest_row_paths_use_aggregation_not_windows(spark, name):
    plan = _plan(spark, name)
    assert "Window" not in plan and "WindowGroupLimit" not in plan


@pytest.mark.parametrize("name", PIPELINES)
def test_no_cartesian_products(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan
    if "BroadcastNestedLoopJoin" in plan:   # only the 1 x 1 ratio of two global counts
        assert name in ("Q2", "Q2_post", "Q3")


def test_period_filter_reaches_the_scan(spark):
    """In the plan that scans the visits: the denominator's, which Q2 stores before it counts."""
    from medwright import constants as K
    from medwright.functions.text import starts_with_any
    from medwright.plans import measures
    from medwright.testing import oracle
    from medwright.testing.testmap import tables_for
    M = oracle.MEASURE
    den = measures.denominator(tables_for(spark, SF_SMALL).measure_tables(), M["start"], M["end"], M["as_of"],
                               lambda c: starts_with_any(c, K.DIABETES_ICD10_PREFIXES), K.DIABETES_AGE)
    plan = den._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan)


def _optimized(spark, name):
    return entry.queries()[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["Q2_counts", "Q3_counts"])
def test_visits_only_qualify_patients(spark, name):
    plan = _optimized(spark, name)
    assert "LeftSemi" in plan


def test_action_log_is_cut_to_the_window_before_it_is_aggregated(spark):
    """Below the aggregate per action, type and user stands a semi-join."""
    from medwright.plans import turnaround
    from medwright.testing import oracle
    from medwright.testing.testmap import TestTables
    t = TestTables(spark, SF_SMALL).tat_tables()
    detail = turnaround.tat_detail(t, oracle.TAT["start"], oracle.TAT["end"])
    lines = detail._jdf.queryExecution().optimizedPlan().toString().splitlines()
    agg = next(i for i, x in enumerate(lines) if "Aggregate [action_id" in x and "user_id" in x)
    depth = lines[agg].index("Aggregate")
    below = [x for x in lines[agg + 1:] if len(x) - len(x.lstrip(" :+-")) > depth]
    assert any("LeftSemi" in x for x in below[:3])
