"""Every query with a SQL twin gives DuckDB's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from conftest import SMALL

from certveil.plans import catalogue

SQL = catalogue.oracle_sql()


def plain(v):
    if v is None or isinstance(v, bool | str):
        return v
    if hasattr(v, "tolist") and not isinstance(v, bytes):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return None if math.isnan(v) else round(float(v), 5)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, duck, name):
    got = catalogue.queries()[name](spark, SMALL)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())
