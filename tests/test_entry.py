"""The entry module: names, columns and the SQL of every query at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

CORE = entry.core


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(rows):
    return sorted(repr(tuple(int(v) if isinstance(v, bool) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(CORE.queries()))
def test_core_query(spark, data, sql, name):
    df = CORE.queries()[name](spark, data)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name in CORE.oracle_sql():
        want = sql.sql(f"select {', '.join(columns)} from ({CORE.oracle_sql()[name]})").fetchall()
        assert plain(rows) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
