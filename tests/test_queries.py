"""Every registered query with SQL gives the rows that DuckDB gives; every other one runs."""

import duckdb
import pandas as pd
import pytest

from concord.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(df):
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return None
        return f"{v:.6g}" if isinstance(v, float) else str(pd.Timestamp(v)) if isinstance(v, pd.Timestamp) else str(v)

    return sorted([tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)], key=str)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small, duck, name):
    got = QUERIES[name](spark, small)
    assert len(set(got.columns)) == len(got.columns)
    got = got.toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert len(got)


def test_names():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 90
