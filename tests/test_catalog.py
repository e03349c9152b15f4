"""Every query with SQL, run on the smallest tables and compared value by value."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver
from check import TABLES, differences, normal

FOLDER = "/root/testdata/sf0.001"
ORACLES = driver.oracle_sql()


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, base, name):
    df = driver.queries()[name](spark, FOLDER)
    relation = base.sql(ORACLES[name])
    got, want = df.toPandas(), relation.df()
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert differences(dict(df.dtypes), kinds, got, want) == []
    pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False, rtol=0, atol=2e-6)


def test_entry_runs(spark):
    assert driver.entry(spark).count() > 0


def test_names():
    assert set(ORACLES) <= set(driver.queries())
