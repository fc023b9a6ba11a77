"""Marts refreshed by month, staged writes, and keys compared without case and accents."""

import tempfile

import pytest
from pyspark.sql import functions as F

from helpers import item, marketplace, order, payment
from tianguis.params import FIXTURE_PARAMS as P
from tianguis.params import Params
from tianguis.plans import geo, marts
from tianguis.plans.registry import fixture_marketplace
from tianguis.sources.files import load_tables
from tianguis.sources.sinks import Slices, write_mart

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def test_refreshing_a_month_equals_a_full_rebuild(spark):
    p = P.with_(scorecard_mart_min_orders=1)
    mk = fixture_marketplace(spark, SF)
    d = tempfile.mkdtemp(prefix="tianguis-refresh-", dir="/tmp")
    marts.refresh_marts(mk, p, f"{d}/a")
    for name in ("monthly", "categories", "delivery_monthly", "seller_scorecard"):
        assert _rows(spark.read.parquet(f"{d}/a/{name}")) == _rows(marts.MARTS[name](mk, p)), name
    exact = {r.estado: r for r in marts.MARTS["states"](mk, p).collect()}
    for r in spark.read.parquet(f"{d}/a/states").collect():
        assert (r.pedidos, r.revenue, r.ticket_promedio) == (exact[r.estado].pedidos, exact[r.estado].revenue, exact[r.estado].ticket_promedio)
        assert abs(r.clientes / exact[r.estado].clientes - 1) < 0.1
    # one month changes: its orders of even ids are canceled, the others lose a day
    in_month = F.date_format("order_purchase_timestamp", "yyyy-MM") == "1997-11"
    changed = mk.replace(orders=mk.orders.withColumns({
        "order_status": F.when(in_month & (F.col("order_id") % 2 == 0), "canceled").otherwise(F.col("order_status")),
        "order_delivered_customer_date": F.when(in_month, F.expr("order_delivered_customer_date - INTERVAL '1' DAY"))
        .otherwise(F.col("order_delivered_customer_date"))}))
    marts.refresh_marts(changed, p, f"{d}/a", ["1997-11"])
    marts.refresh_marts(changed, p, f"{d}/b")
    for name in marts.MARTS:
        assert _rows(spark.read.parquet(f"{d}/a/{name}")) == _rows(spark.read.parquet(f"{d}/b/{name}")), name
    assert _rows(spark.read.parquet(f"{d}/a/monthly")) != _rows(marts.MARTS["monthly"](mk, p))


def test_a_month_that_becomes_empty_goes(spark):
    d = tempfile.mkdtemp(prefix="tianguis-slices-", dir="/tmp")
    s = Slices(spark, f"{d}/t", "m")
    assert s.read() is None and s.values() == []
    s.replace(spark.createDataFrame([("2017-01", 1), ("2017-02", 2)], "m string, x int"))
    s.replace(spark.createDataFrame([("2017-02", 5), ("2017-03", 9)], "m string, x int"), ["2017-02"])
    assert _rows(s.read()) == [("2017-01", 1), ("2017-02", 5)]
    s.replace(spark.createDataFrame([], "m string, x int"), ["2017-01"])
    assert _rows(s.read()) == [("2017-02", 5)] and s.values() == ["2017-02"]
    s.replace(spark.createDataFrame([], "m string, x int"))
    assert s.read().collect() == [] and s.read().columns == ["x", "m"]


def test_a_failed_write_leaves_the_old_table(spark):
    d = tempfile.mkdtemp(prefix="tianguis-staged-", dir="/tmp")
    good = spark.createDataFrame([(1, 2.0)], "a int, b double")
    bad = good.select(F.raise_error(F.lit("no")).cast("int").alias("a"), "b")
    write_mart(good, f"{d}/mart")
    with pytest.raises(Exception, match="no"):
        write_mart(bad, f"{d}/mart")
    assert _rows(spark.read.parquet(f"{d}/mart")) == [(1, 2.0)]
    write_mart(spark.read.parquet(f"{d}/mart").withColumn("a", F.lit(7)), f"{d}/mart")   # from itself
    assert _rows(spark.read.parquet(f"{d}/mart")) == [(7, 2.0)]
    s = Slices(spark, f"{d}/slices", "m")
    s.replace(spark.createDataFrame([("x", 1)], "m string, a int"))
    with pytest.raises(Exception, match="no"):
        s.replace(spark.createDataFrame([("x", 1)], "m string, a int").withColumn("a", F.raise_error(F.lit("no")).cast("int")), ["x"])
    assert _rows(s.read()) == [(1, "x")]
    s.replace(spark.createDataFrame([("x", 3)], "m string, a int"), ["x"])
    assert _rows(s.read()) == [(3, "x")]


def test_collated_keys(spark):
    mk = marketplace(
        spark,
        orders=[order(o, delivered="2017-05-05 10:00:00", estimated="2017-05-20 00:00:00", customer=c)
                for o, c in (("a", "c1"), ("b", "c2"), ("c", "c3"))],
        payments=[payment("a", 10), payment("b", 20), payment("c", 40)],
        customers=[{"customer_id": c, "customer_unique_id": c, "customer_state": s}
                   for c, s in (("c1", "São Paulo"), ("c2", "sao paulo"), ("c3", "Rio"))],
        items=[item("a", product="p1", price=1), item("b", product="p2", price=2), item("c", product="p3", price=4)],
        products=[{"product_id": q, "product_category_name": n} for q, n in (("p1", "Café"), ("p2", "CAFE"), ("p3", "chá"))],
        translation=[{"product_category_name": "cafe", "product_category_name_english": "coffee"}])
    d = tempfile.mkdtemp(prefix="tianguis-collate-", dir="/tmp")
    paths = {}
    for name, df in mk.tables().items():
        paths[name] = f"{d}/{name}"
        df.write.parquet(paths[name])
    p = Params()
    plain = load_tables(spark, paths)
    folded = load_tables(spark, paths, collate=("customer_state", "product_category_name"))
    assert sorted(r.revenue for r in geo.state_revenue(plain, p).collect()) == [10, 20, 40]
    states = {r.estado.lower().replace("ã", "a"): r.revenue for r in geo.state_revenue(folded, p).collect()}
    assert states == {"sao paulo": 30.0, "rio": 40.0}
    assert {r.categoria: r.revenue for r in geo.category_mart(plain, p).collect()} == {"Sin categoría": 7.0}
    assert {r.categoria: r.revenue for r in geo.category_mart(folded, p).collect()} == {"coffee": 3.0, "Sin categoría": 4.0}
    assert len(geo.top_products(folded, p).collect()) == 3
