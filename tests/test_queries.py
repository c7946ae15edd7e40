"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def rounded(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v + 0.0, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", entry.oracle_sql())
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(entry.oracle_sql()[name])
    at = {d[0]: k for k, d in enumerate(found.description)}
    assert sorted(at) == columns
    want = sorted((tuple(rounded(r[at[c]]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
