"""Every query that has SQL, held against it by DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from haplospark import file_queries, queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, name):
    pd.testing.assert_frame_equal(rows(queries.QUERIES[name](spark, SF).toPandas()), rows(duck.execute(queries.SQL[name]).df()), check_dtype=False, rtol=0, atol=1e-9)


def test_rows_only(spark):
    assert queries.pca_rr(spark, SF).count() == 4


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())
