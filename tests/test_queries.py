"""Every registered query against its SQL check on the smallest data set."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from basinlens.plans import catalogue
from basinlens.plans.tables import BASE

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for name in BASE:
        c.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return c


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.PLANS))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    got = table(df.columns, df.collect())
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert not [str(k) for k in want.types if str(k) == "HUGEINT" or str(k).startswith(("DECIMAL", "STRUCT", "MAP"))]
    assert got == table(want.columns, want.fetchall())


def test_every_query_has_a_check():
    assert set(catalogue.PLANS) == set(catalogue.CHECKS)
    assert set(catalogue.PLANS) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
