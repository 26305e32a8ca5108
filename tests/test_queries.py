"""Every registered query with SQL is compared with DuckDB on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.5f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 150


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    cur = duck.execute(SQL[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == cols
    want = sorted(tuple(norm(r[at.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
