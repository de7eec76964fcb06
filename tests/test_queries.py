"""Every registered geometry query against DuckDB on the smallest tables, and the registry itself."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from terraframe.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(df):
    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(value(x) for x in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert [r for r in zip(a, b) if r[0] != r[1]][:3] == [] and len(a) == len(b)


def test_registry(spark):
    assert set(SQL) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
