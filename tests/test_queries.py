"""Every engine query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from fieldscope import clock_queries, log_queries, queries, tool_queries

MODULES = (queries, tool_queries, clock_queries, log_queries)
SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def rows(d):
    plain = lambda x: None if pd.isna(x) else int(x) if isinstance(x, float) and x.is_integer() else x
    return sorted(repr([plain(x) for x in r]) for r in d[sorted(d.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", SQL)
def test_equals_sql(spark, con, name):
    got = next(m.QUERIES[name] for m in MODULES if name in m.QUERIES)(spark, DATA).toPandas()
    want = con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_every_query_is_registered_once():
    names = [n for m in MODULES for n in m.QUERIES]
    assert len(names) == len(set(names))
