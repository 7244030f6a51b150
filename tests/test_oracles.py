"""Every query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: The corpus operators have tests of their own.
NAMES = sorted(n for n in entry.oracle_sql() if not (n[:2] == "op" and n[2].isdigit()))


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "null" if v is None or (isinstance(v, float) and v != v) or v is pd.NaT else f"{v:.6f}" if isinstance(v, float) else str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, duck, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    got = canonical(entry.queries()[name](spark, SF).toPandas())
    want = canonical(duck.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want)


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
