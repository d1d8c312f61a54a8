"""Every registered query against its SQL on the smallest data set."""

import os

import pytest
from oracle import compare, connect

from colonnade.plans.registry import load_all

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, message = compare(spark, con, QUERIES[name], SF)
    assert ok, message


def test_every_query_has_sql():
    assert not [n for n, q in QUERIES.items() if q.sql is None]


def test_entry_points_need_no_session():
    import __spark_entry__ as e
    assert set(QUERIES) <= set(e.queries()) and set(QUERIES) <= set(e.oracle_sql())
