"""Every registered query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from tallygrove.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for name in os.listdir(SF):
        c.execute(f"create view {name.partition('.')[0]} as select * from '{SF}/{name}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.6g}")
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, connection, name):
    got = registry.QUERIES[name](spark, SF)
    want = connection.execute(registry.ORACLES[name])
    columns = sorted(x[0] for x in want.description)
    assert sorted(got.columns) == columns
    names = [x[0] for x in want.description]
    rows = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in want.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == rows


def test_oracles_belong_to_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
