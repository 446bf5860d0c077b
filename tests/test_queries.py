"""Every query against its DuckDB SQL, and checks of the plans."""

import re

import pytest
from compare import differences, duck
from conftest import plan_of

import __spark_entry__ as contract
from tiercurve.plans import oracles, registry

TINY = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(TINY)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, TINY), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", QUERIES)
def test_plan(spark, name):
    plan = plan_of(QUERIES[name](spark, TINY))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert forbidden not in plan
    # No window over all rows of a year: the ordered windows are within a step or over steps.
    for order_by in re.findall(r"windowspecdefinition\((.*?), specifiedwindowframe", plan):
        if "_point" in order_by.split(", ")[-1]:
            assert "_step" in order_by


@pytest.mark.parametrize(
    "name, rows",
    [("net_customer_summary", 1489), ("customer_period_summary", 63877), ("pareto_curve", 7837), ("rank_band_gold", 3074)],
)
def test_known_row_counts(spark, name, rows):
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() == rows


def test_returns_are_an_anti_join(spark):
    assert "LeftAnti" in plan_of(QUERIES["net_customer_summary"](spark, TINY))


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == [
        "std_ym", "grd_cd", "grd_nm", "case1", "case2", "경쟁사", "n", "case1_prop", "case2_prop", "rival_prop",
    ]
    assert df.count() > 0
