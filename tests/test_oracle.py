"""Every registered query against its SQL on the smallest data."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from sitescan_queries.oracle import ORACLE_SQL
from sitescan_queries.registry import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_with_sql_is_registered():
    assert set(ORACLE_SQL) == set(QUERIES)
    assert set(ORACLE_SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLE_SQL[name], SF_DIR) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
