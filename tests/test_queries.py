"""Every registered query against its SQL."""

import glob
import os

import pandas as pd
import pytest

from tidemark import catalogue as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    duckdb = pytest.importorskip("duckdb")
    out = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        out.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return out


def _rows(frame: pd.DataFrame, columns: list[str]) -> list[str]:
    def plain(v):
        if v is None or v is pd.NaT or v != v:
            return None
        if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "") in tuple("iuf"):
            return float(v)
        return str(pd.Timestamp(v)) if hasattr(v, "year") else str(v)

    return sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query(spark, connection, name):
    got, want = q.QUERIES[name](spark, SF).toPandas(), connection.sql(q.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert _rows(got, columns) == _rows(want, columns)
