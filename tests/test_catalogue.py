"""Every query with SQL gives the rows of that SQL; every query runs."""

import math

import duckdb
import pytest

import __spark_entry__
from plumbline import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9) + 0.0
        return v.isoformat(" ") if hasattr(v, "isoformat") else v

    return sorted(repr([cell(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    found = [tuple(r) for r in df.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert found
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, found) == rows(want.columns, want.fetchall())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 12 and "eta_squared" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
