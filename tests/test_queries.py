"""Every registered query runs, and gives what its SQL gives, at the smallest scale."""

import os

import pytest
from compare import connect, difference
from conftest import TESTDATA

import __spark_entry__ as entry_point
from plotflux.catalog import QUERIES

FOLDER = os.path.join(TESTDATA, os.environ.get("TEST_SF", "sf0.001"))
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    df = entry_point.queries()[key](spark, FOLDER)
    sql = entry_point.oracle_sql().get(key)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, duck, sql) is None


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
