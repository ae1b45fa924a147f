"""Every query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from payloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def shown(frame):
    def one(v):
        if v is None or v is pd.NaT or v != v:
            return "null"
        if isinstance(v, float):
            return f"{v:.6g}"
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)

    cols = sorted(frame.columns)
    return sorted(tuple(one(v) for v in row) for row in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf, name):
    got = registry.queries()[name](spark, sf).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:
        if "float" in str(got[c].dtype) or "float" in str(want[c].dtype):
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert len(got) == len(want) and shown(got) == shown(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
