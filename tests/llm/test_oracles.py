"""The queries that SQL can express, against DuckDB on the same tables."""

import duckdb
import pytest

from gridloom import llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = llm.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(r) for r in df.select(columns).collect())
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({llm.oracle_sql()[name]})").fetchall())
    assert got == want
