"""Every registered query with SQL against DuckDB on the smallest tables, by values."""

import os

import duckdb
import pandas as pd
import pytest

from factweave import queries as engine

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return c


def canonical(df: pd.DataFrame) -> list:
    text = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(x) for x in row) for row in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got, want = engine.queries()[name](spark, FOLDER).toPandas(), con.sql(engine.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_flagship(spark):
    rows = {r.severity: r.n for r in engine.flagship(spark, FOLDER).collect()}
    assert list(rows) and rows["Critical"] == 0 and rows["High"] > 0


def test_queries_without_sql_run(spark):
    for name in set(engine.queries()) - set(engine.oracle_sql()):
        assert engine.queries()[name](spark, FOLDER).count() >= 0
