"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from fathomline.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def text(df: pd.DataFrame) -> pd.DataFrame:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):
            return "0" if abs(v) < 1e-9 else f"{v:.7g}"
        return str(pd.Timestamp(v)) if hasattr(v, "year") else str(v)

    out = df[sorted(df.columns)].map(one)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, db, name):
    got, want = catalogue.queries()[name](spark, DIR).toPandas(), db.execute(catalogue.oracle_sql()[name]).df()
    # counts of a nullable column come back as floats from pandas
    for c in got.columns:
        if pd.api.types.is_float_dtype(got[c]) != pd.api.types.is_float_dtype(want[c]) and pd.api.types.is_numeric_dtype(want[c]) and pd.api.types.is_numeric_dtype(got[c]):
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    pd.testing.assert_frame_equal(text(got), text(want))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    df = catalogue.queries()[name](spark, DIR)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
