"""Every query with SQL is held against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyplan.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE_SQL)))
def test_equals_sql(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    got = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    assert rows == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
