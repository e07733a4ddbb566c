"""Every registered core query against its SQL on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from lectorium.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    r = duck.execute(SQL[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    names = sorted(cols)
    mine = sorted(repr(tuple(plain(row[c]) for c in names)) for row in df.collect())
    theirs = sorted(repr(tuple(plain(row[cols.index(c)]) for c in names)) for row in r.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns
    df.limit(5).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
