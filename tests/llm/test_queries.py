"""The queries of the package against their SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from quillon.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = llm.queries()[name](spark, data)
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(columns)} from ({llm.oracle_sql()[name]})").fetchall()
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(map(repr, want))
