"""Tasks of the seller reports get about as many items whatever the number of items and the session's settings."""

import re

from pyspark.sql import functions as F

from helpers import item, marketplace, order, review
from tianguis.params import Params
from tianguis.plans import extras, sellers
from tianguis.sources.model import TABLES, Marketplace

P = Params(scorecard_min_orders=1, scorecard_mart_min_orders=1)
PLANS = (sellers.seller_segments, sellers.seller_scorecard, sellers.top_sellers, sellers.bottom_sellers,
         sellers.seller_scorecard_mart, extras.top_seller_share)


def _parts(spark, plan, mk, p):
    """Partition counts of the exchanges by order id, two shuffle partitions being set."""
    for k, v in (("spark.sql.shuffle.partitions", "2"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(k, v)
    try:
        text = plan(mk, p)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return [int(n) for n in re.findall(r"hashpartitioning\(order_id#\d+, (\d+)\)", text)]


def test_partitions_follow_the_items(spark):
    small = marketplace(spark, orders=[order("1")], items=[item("1")])
    for n in (1_200_000, 6_000_000):
        many = spark.range(n).select(F.col("id").cast("string").alias("order_id"), F.col("id").cast("string").alias("seller_id"),
                                     F.lit(1).alias("order_item_id"), F.lit("p").alias("product_id"),
                                     F.lit(1).cast("decimal(18,2)").alias("price"), F.lit(1).cast("decimal(18,2)").alias("freight_value"))
        for plan in PLANS:
            mk = Marketplace(**{f: small.table(f) for f in TABLES} | {"items": many})
            parts = _parts(spark, plan, mk, P)
            assert len(parts) >= 2 and len(set(parts)) == 1 and n / parts[0] <= 500_000, plan
            mk.bucketed = True
            assert set(_parts(spark, plan, mk, P)) == {2}, plan


def test_dealt_items_give_the_same_rows(spark):
    orders, items, reviews = [], [], []
    for i in range(200):
        oid = f"o{i % 190}"                                     # some orders come twice
        orders.append(order(oid, status="delivered" if i % 9 else "canceled", delivered=f"2017-05-{2 + i % 20:02d} 10:00:00" if i % 7 else None,
                            estimated="2017-05-12 00:00:00" if i % 11 else None))
        items += [item(oid, k, price=3 + i % 13, seller=f"s{(i + k) % 5}") for k in range(1 + i % 4)]
        reviews += [review(oid, 1 + i % 5 if i % 6 else None, f"r{i}{k}") for k in range(i % 3)]
    items += [item("o1", 9) | gap for gap in ({"order_id": None}, {"seller_id": None}, {"price": None}) for _ in range(2)]
    mk = marketplace(spark, orders=orders + [order("x") | {"order_id": None}], items=items + [item("o5", k) for k in range(300)],
                     reviews=reviews + [review("x", 3) | {"order_id": None}],
                     sellers=[{"seller_id": f"s{i % 5}", "seller_state": f"T{i % 6}"} for i in range(8)])
    for plan in PLANS:
        whole = sorted(map(str, plan(mk, P.with_(items_per_task=0)).collect()))
        assert whole and sorted(map(str, plan(mk, P.with_(items_per_task=10)).collect())) == whole, plan


def test_a_slice_counts_as_its_whole_table(spark):
    mk = marketplace(spark, items=[item("a", k) for k in range(5)])
    part = mk.replace(items=lambda: mk.items.limit(1))
    assert part.rows("items") == mk.rows("items") == 5 and part.built == set()
