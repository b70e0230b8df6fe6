import duckdb
import pandas as pd
import pytest

from textloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    key = next(c for c in ("doc_id", "conv_id") if c in want)
    want = want.sort_values(key).reset_index(drop=True)
    got = queries.queries()[name](spark, sf).toPandas().sort_values(key).reset_index(drop=True)
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False)
