"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from tidemark.plans import catalog

DIR = os.environ.get("TIDEMARK_TEST_DIR", "/root/testdata/sf0.001")
Q, S = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v + 0.0:.5f}".replace("-0.00000", "0.00000")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(S))
def test_query_equals_sql(spark, duck, name):
    df = Q[name](spark, DIR)
    got = duck.execute(S[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q) - set(S)))
def test_query_without_sql_runs(spark, name):
    df = Q[name](spark, DIR)
    assert df.columns and df.count() > 0


def test_every_sql_has_a_query():
    assert set(S) <= set(Q)
