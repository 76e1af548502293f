"""Every registered query against its DuckDB counterpart, row for row."""

import pytest

import __spark_entry__ as entry
from strikelake.oracle import sql
from strikelake.plans import catalog
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.01"
QUERIES, ORACLES = catalog.QUERIES, sql.oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"StopLoss", "EntryAllowed", "ROC_AVG_close"} <= set(df.columns)
