"""Cubes of more lines than the smallest tables have, and maps that leave them below, against the queries' SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from terraspan.plans import all as library
from tests.test_queries import ordered


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """100 lines of traces; the map passes the last sample from line 83 on."""
    at, rnd = tmp_path_factory.mktemp("cube"), np.random.default_rng(2)
    ids = np.arange(2500)
    values = rnd.integers(-512, 512, (len(ids), 64)) / 256
    own = pd.DataFrame({"vec_id": ids, "embedding": list(values.astype("float32")), "label": ids % 5})
    own.to_parquet(at / "embeddings.parquet")
    return at


def same_as_sql(spark, tables, name):
    got = library.QUERIES[name](spark, str(tables)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tables}/embeddings.parquet'")
    want = con.sql(library.SQL[name]).df()
    assert len(want) > 1000
    pd.testing.assert_frame_equal(ordered(got), ordered(want), check_dtype=False, rtol=1e-12, atol=0)


def test_linear_slice_ends_with_the_cube(spark, tables):
    same_as_sql(spark, tables, "cube_slice_linear")


def test_nearest_slice_ends_half_a_step_beyond(spark, tables):
    same_as_sql(spark, tables, "cube_slice_nearest")


def test_windows_on_all_lines_of_the_cube(spark, tables):
    same_as_sql(spark, tables, "cube_window_map")
