"""Every registered query against its SQL in another engine, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from lexloom import registry

SF_DIR = os.environ.get("LEXLOOM_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.sql(f"create view {name[:-8]} as select * from read_parquet('{SF_DIR}/{name}')")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


def rows(found, columns):
    return sorted((tuple(plain(v) for v in r) for r in found), key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in columns]).collect()
    if name not in ORACLE:
        assert got
        return
    result = duck.sql(ORACLE[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    want = [tuple(r[i] for i in at) for r in result.fetchall()]
    assert rows(got, columns) == rows(want, columns)


def test_keys_name_their_operator():
    assert all(n[0].isalpha() and n[1:3].isdigit() for n in QUERIES)
    assert set(ORACLE) <= set(QUERIES)
