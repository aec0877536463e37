"""Every query with SQL agrees with it at the smallest size; every other one has rows."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tidemark.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr([None if pd.isna(v) else round(v, 6) + 0.0 if isinstance(v, float) else str(v) for v in r]) for r in frame.values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, connection, name):
    got, want = QUERIES[name](spark, SF).toPandas(), connection.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
