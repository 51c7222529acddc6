"""Every registered query against its SQL, and the shape of its plan."""

import pytest
from conftest import SF
from parity import compare, duck

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    pdf = got.toPandas()
    if name in ORACLE:
        assert compare(pdf, con.execute(ORACLE[name]).df()) == ""
    else:
        assert len(pdf) > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["ts_id", "meter_type", "detected_at", "window_mean", "window_std", "offending_value", "z_score"]


def test_filters_reach_the_scan(spark):
    from standin_queries.base import reading
    from parcelwatt.operators import timeseries as ts
    from datetime import datetime

    plan = ts.resample(reading(spark, SF), "hourly", datetime(2024, 1, 3))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "props" not in plan
