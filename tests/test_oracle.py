"""Every registered query against DuckDB on the driver tables."""

import os

import pytest
from compare import connect, difference, plan_of

import __spark_entry__ as driver
from capfolio.plans.catalog import QUERIES

FOLDER = os.environ.get("CAPFOLIO_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_duckdb_without_cross_join_or_python(spark, duck, name):
    frame = driver.queries()[name](spark, FOLDER)
    assert difference(frame, duck, driver.oracle_sql()[name]) is None
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas"):
        assert banned not in plan_of(frame)


def test_entry_runs(spark):
    assert driver.entry(spark).count() > 0
