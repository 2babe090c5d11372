"""Every query of the core against its SQL at the smallest size, and the driver contract."""

import os

import duckdb
import pandas as pd
import pytest

import graphloom.queries_more  # noqa: F401
import graphloom.queries_text  # noqa: F401
from graphloom.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{D}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def canon(df):
    show = lambda x: "" if x is None or x is pd.NaT or x is pd.NA or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, D)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns)
    assert len(got)
    if name in ORACLE_SQL:
        assert canon(got) == canon(con.execute(ORACLE_SQL[name]).df())


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
