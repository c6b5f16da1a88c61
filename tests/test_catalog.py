"""Every checked query against its SQL."""

import re

import pytest
from oracle import compare, connect

from dailycast.catalog import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    assert compare(spark, db, ROOT, QUERIES[name], ORACLES[name]) is None


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.queries().items() >= QUERIES.items() and entry.oracle_sql().items() >= ORACLES.items()
    df = entry.entry(spark)
    assert df.columns[0] == "date" and not df.isEmpty()
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in QUERIES)
