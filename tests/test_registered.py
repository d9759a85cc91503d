"""Every registered query against DuckDB on the smallest tables."""

import pytest

from __spark_entry__ import entry
from tests.compare import connect, difference
from tidelog.registered import load

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, con, name):
    assert difference(spark, con, SF_DIR, name, QUERIES, ORACLES) is None


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    assert entry(spark).columns == ["user_id", "ts", "events"]
