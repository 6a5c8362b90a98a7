"""Every query with SQL against DuckDB on the same tables, and the shape of the entry module."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__
from docketry.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()
#: Queries that SQL does not express; each has a test of its own.
WITHOUT_SQL: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL and not set(ORACLE) - set(QUERIES)
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE) <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 25


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    order = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
