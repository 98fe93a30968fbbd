"""Every query with SQL against DuckDB on the same tables; the others must run."""

import duckdb
import numpy as np
import pytest

from gridloom import catalogue

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def plain(v):
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    if isinstance(v, float | np.floating):
        return round(float(v), 6) + 0.0
    return int(v) if isinstance(v, int | np.integer) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(str([plain(v) for v in r]) for r in df.select(columns).collect())
    table = duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(table.columns) == columns
    want = sorted(str([plain(v) for v in r]) for r in table[columns].itertuples(index=False))
    assert got == want


def test_morphology_reports_every_label(spark):
    wide = "/root/testdata/sf0.01"
    got = {r.id: r for r in catalogue.QUERIES["morphology"](spark, wide).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{wide}/events.parquet'")
    want = con.execute(f"WITH {catalogue.VX} SELECT ws, count(*), round(avg(z), 6), round(avg(y), 6), round(avg(x), 6), min(z), max(x) FROM vx GROUP BY ws").fetchall()
    assert len(want) == 200 and set(got) == {0} | {w[0] for w in want}
    for ws, *rest in want:
        r = got[ws]
        assert [r.size, r.com_z, r.com_y, r.com_x, r.bbmin_z, r.bbmax_x] == pytest.approx(rest)


def test_names_are_paired():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(e.queries())
