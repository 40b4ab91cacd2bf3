"""Every query against its SQL, as DuckDB runs it over the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from terraspan.plans import all as library

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    own = df[sorted(df.columns)]
    return own.sort_values(list(own.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query(spark, duck, name):
    got = library.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in library.SQL:
        pd.testing.assert_frame_equal(ordered(got), ordered(duck.sql(library.SQL[name]).df()), check_dtype=False, rtol=1e-12, atol=0)
