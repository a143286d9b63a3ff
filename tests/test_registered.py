"""Every registered query against its SQL, on the smallest tables."""

import datetime as dt
import decimal
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as contract  # noqa: E402
from conftest import SF  # noqa: E402

QUERIES = {k: q for k, q in contract.queries().items() if k in contract.registered_queries.QUERIES}
SQL = {k: q for k, q in contract.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(x):
    if isinstance(x, (decimal.Decimal, int)) and not isinstance(x, bool):
        return float(x)
    if isinstance(x, float) and x != x:
        return "nan"
    return str(x) if isinstance(x, (dt.date, bool)) else x


def canonical(found, columns, names):
    place = [columns.index(n) for n in names]
    return sorted((tuple(plain(r[i]) for i in place) for r in found), key=lambda r: tuple(map(str, r)))


def test_each_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    want = db.sql(SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    assert canonical(df.collect(), df.columns, names) == canonical(want.fetchall(), want.columns, names)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
