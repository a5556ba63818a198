"""The registered queries of the point-cloud engine against DuckDB."""

import glob
import os

import pytest

from cloudloom.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", ORACLE)
def test_against_duckdb(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    tidy = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert tidy(df.select(*columns).collect()) == tidy(want.select(*columns).fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["grp", "center", "radius", "n", "max", "mean", "std", "zeros"]
    assert set(QUERIES) <= set(entry.queries())
