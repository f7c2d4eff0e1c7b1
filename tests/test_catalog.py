"""Every registered query against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quarry import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"bfr", "bfr_rounds"}


@pytest.fixture(scope="module")
def duck():
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def comparable(frame: pd.DataFrame) -> pd.DataFrame:
    out = frame[sorted(frame.columns)].copy()
    for c in out.columns:
        out[c] = out[c].map(str) if out[c].dtype == object else out[c].astype(float)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(set(catalog.SQL)))
def test_matches_duckdb(spark, duck, name):
    mine = comparable(catalog.QUERIES[name](spark, DATA).toPandas())
    theirs = comparable(duck.sql(catalog.SQL[name]).df())
    pd.testing.assert_frame_equal(mine, theirs, check_dtype=False, check_exact=True)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL) - SLOW))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).columns
