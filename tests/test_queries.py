import os

import duckdb
import pandas as pd
import pytest

from lodestrata.plans.catalogue import ORACLE, QUERIES


def plain(v):
    if isinstance(v, bool):
        return v
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return None
    if isinstance(v, float):
        return round(v, 4) + 0.0
    return v.isoformat()[:26] if hasattr(v, "isoformat") else v


def rows(df):
    return sorted(repr(tuple(plain(v) for v in r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in os.listdir(data):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{data}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in ORACLE:
        want = duck.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
