"""Every query with SQL equals DuckDB's answer at sf0.001; the others run."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestack import plans

SF = "/root/testdata/sf0.001"


def shown(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF)
    rows, columns = got.collect(), sorted(got.columns)
    sql = plans.sql().get(name)
    if sql is None:
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted(tuple(shown(r[c]) for c in columns) for r in rows) == sorted(tuple(shown(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(plans.queries()) <= set(entry.queries()) and set(plans.sql()) <= set(entry.oracle_sql())
