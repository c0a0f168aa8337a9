"""Every registered query of the catalogue against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quarrywork.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is pd.NA or x is None or x is pd.NaT or x != x:
            return "~"
        return f"{x:.6f}" if isinstance(x, float) and x != int(x) else str(int(x)) if isinstance(x, float) else str(x)

    columns = sorted(frame.columns)
    return sorted(tuple(one(x) for x in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    rows = catalog.QUERIES[name](spark, DATA).toPandas()
    assert len(rows.columns)
    if name in catalog.ORACLES:
        expected = duck.execute(catalog.ORACLES[name]).df()
        assert sorted(rows.columns) == sorted(expected.columns)
        assert plain(rows) == plain(expected)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
