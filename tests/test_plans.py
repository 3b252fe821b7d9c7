"""Physical plans: no products of tables, no row-at-a-time Python, filters and columns in the scans."""

import re

import pytest

from tessera.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
#: Joins with a table of one row, or a product of two fixed small ranges.
ONE_ROW = {"arrays_and_lines", "false_stop_distances", "js_divergence", "numbered_files", "recovery_offsets", "representative_order", "salvage_unions", "tolerant_files", "wilcoxon"}
#: Resampling, packed rasters and machines that read rows in order, which columns cannot express.
PYTHON = {"bootstrap_delta", "episode_machine", "packed_changes", "packed_depths", "packed_masks", "stored_arrays"}


def _plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, name):
    plan = _plan(spark, name)
    if name not in ONE_ROW:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if name not in PYTHON:
        assert not re.search("InPandas|ArrowEvalPython|InArrow", plan)


def test_filters_and_columns_reach_the_scan(spark, capsys):
    QUERIES["forecast_revenue"](spark, FOLDER).explain("formatted")
    plan = capsys.readouterr().out
    assert all(f in re.search(r"PushedFilters: \[.*", plan)[0] for f in ("GreaterThanOrEqual(l_discount,0.05)", "LessThanOrEqual(l_discount,0.07)", "LessThan(l_quantity,24.0)"))
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double>" in plan
    QUERIES["long_counts"](spark, FOLDER).explain("formatted")
    assert "ReadSchema: struct<lang:string,source:string>" in capsys.readouterr().out
