"""Every query with SQL agrees with DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from tidegrid.plans import demo, demo_sql

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def told(v):
    if isinstance(v, float):
        return "None" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(demo_sql.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = demo.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    ours = sorted([told(r[c]) for c in names] for r in df.collect())
    found = duck.execute(demo_sql.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert ours == sorted([told(r[k]) for k in at] for r in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
