"""Every registered query against its SQL twin, and the contract functions."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
QUERIES, TWINS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_twins_have_queries():
    assert set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_matches_sql(spark, db, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), db.execute(TWINS[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got)[1] == rows_of(want)[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_query_runs(spark, name):
    rows = QUERIES[name](spark, FOLDER).count()
    assert rows == 0 if name == "d05_patch_law" else rows > 0
