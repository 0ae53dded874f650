"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tapeline import queries as Q

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("nation", "lineitem", "orders", "supplier", "customer", "events"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, duck, name):
    got = Q.queries()[name](spark, DIR)
    want = duck.sql(Q.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(Q.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
