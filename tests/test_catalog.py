"""Every query with SQL is held against DuckDB on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from quillon.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are needed")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def table(rows, columns):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = table(df.collect(), df.columns)
    result = duck.execute(catalog.ORACLES[name])
    assert got == table(result.fetchall(), [c[0] for c in result.description])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
