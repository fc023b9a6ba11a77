"""Every registered plan equals its independent DuckDB statement on the
smoke-size test data (row count, column names and types, sorted values)."""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from tianguis.plans.registry import PLANS

SF = "/root/testdata/sf0.001"
RAW = ["nation", "customer", "supplier", "part", "orders", "lineitem"]


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def _sorted(rows, order):
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.fixture(scope="module")
def duck():
    if not os.path.exists(f"{SF}/orders.parquet"):
        pytest.skip("test data not present")
    con = duckdb.connect()
    for t in RAW:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(PLANS) <= set(E.oracle_sql()) and set(PLANS) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["mes", "pedidos", "revenue", "ticket_promedio"]
    assert df.count() > 0


TYPE = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}


@pytest.mark.parametrize("name", sorted(PLANS))
def test_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF)
    s_cols = sdf.columns
    s_types = [TYPE.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields]
    s_rows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(E.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    d_types = [str(d[1]) for d in res.description]
    d_rows = res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    so = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    do = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
    assert [s_types[i] for i in so] == [d_types[i] for i in do]
    assert _sorted(s_rows, so) == _sorted(d_rows, do)
