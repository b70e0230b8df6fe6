import os

import duckdb
import pytest

import __spark_entry__
from textloom import queries as base

NAMES = [n for n in base.queries() if n in base.oracle_sql()]


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, data, name):
    got = base.queries()[name](spark, data).toPandas()
    want = duck.execute(base.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True).astype(object) for x in (got, want))
    a, b = a.where(a.notna(), None), b.where(b.notna(), None)
    assert a.equals(b) or all(x == y for c in columns for x, y in zip(a[c], b[c], strict=True))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["word", "df", "k", "n", "fitness"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
