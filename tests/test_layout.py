"""Bucketed fact tables: order_id joins between them run without a shuffle."""

import re
import tempfile
import uuid

from tianguis.params import FIXTURE_PARAMS as P
from tianguis.plans import quality, sellers
from tianguis.plans.registry import fixture_marketplace
from tianguis.sources.layout import load_bucketed, save_bucketed


def test_bucketed_layout_removes_order_id_shuffles(spark):
    mk = fixture_marketplace(spark, "/root/testdata/sf0.001")
    base = tempfile.mkdtemp(prefix="tianguis-bucketed-", dir="/tmp")
    names = save_bucketed(spark, mk, base, buckets=8, prefix=f"t{uuid.uuid4().hex[:8]}_")
    bmk = load_bucketed(spark, names)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = quality.orders_without_payment(bmk, P)._jdf.queryExecution().executedPlan().toString()
        score = sellers.seller_scorecard(bmk, P)._jdf.queryExecution().executedPlan().toString()
        same = sorted(map(tuple, sellers.seller_scorecard(bmk, P).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin" in plan
    assert not re.search(r"Exchange hashpartitioning\(order_id", plan), plan
    assert not re.search(r"Exchange hashpartitioning\(order_id", score), score
    assert same == sorted(map(tuple, sellers.seller_scorecard(mk, P).collect()))
