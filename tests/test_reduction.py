"""What is read and shuffled: only the tables a plan names, payments of the slice, one exchange of items."""

import re

from pyspark.sql import functions as F

from tianguis.operators.reduction import keep_matching
from tianguis.params import FIXTURE_PARAMS as P
from tianguis.plans import geo, quality, sellers, temporal
from tianguis.plans.registry import PLANS
from tianguis.sources.fixture import from_tpch

SF = "/root/testdata/sf0.001"


def cluster_plan(spark, df) -> str:
    """The plan as a large cluster makes it: no side is known to be small."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return df()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_plan_builds_only_the_tables_it_reads(spark):
    for name, tables in {"f1_nulls_products": {"products"}, "f2_price_freight": {"items", "orders"},
                         "f3_weekday": {"orders"}, "f5_delivery_stats": {"orders"}}.items():
        mk = from_tpch(spark, SF)
        PLANS[name](mk, P)
        assert mk.built == tables, name


def test_replacing_a_table_builds_no_other(spark):
    mk = from_tpch(spark, SF)
    other = mk.replace(products=mk.products.limit(1))
    assert quality.product_nulls(other, P).first().total == 1
    assert other.built == {"products"} and mk.built == {"products"}


def test_items_cross_one_exchange_before_the_sellers(spark):
    for plan in (sellers.seller_segments, sellers.seller_scorecard, sellers.top_sellers, sellers.bottom_sellers,
                 sellers.seller_scorecard_mart):
        mk = from_tpch(spark, SF)
        lines = cluster_plan(spark, lambda: plan(mk, P)).splitlines()  # noqa: B023
        # one exchange by order id for each of items, orders, reviews; nothing by (order, seller)
        hashed = [x for x in lines if re.search(r"Exchange hashpartitioning\(order_id#\d+, \d+\)", x)]
        assert len(hashed) <= 3 and not any(re.search(r"hashpartitioning\(order_id#\d+, seller_id", x) for x in lines)


def test_revenue_by_state_needs_no_distinct_counts(spark):
    mk = from_tpch(spark, SF)
    for plan in (geo.pareto_states, geo.state_balance):
        text = cluster_plan(spark, lambda: plan(mk, P))  # noqa: B023
        assert "collect_set" not in text
        assert not re.search(r"hashpartitioning\(estado#\d+, ", re.sub(r"hashpartitioning\(estado#\d+, \d+\)", "", text))


def test_payments_are_reduced_to_the_slice(spark):
    mk = from_tpch(spark, "/root/testdata/sf0.01")
    window = temporal.in_window(temporal.PTS, P.peak_start, P.peak_end)
    some = mk.orders.where(window).select("order_id")
    all_of = mk.payments.select("order_id", "payment_value")
    kept = keep_matching(all_of, some, "order_id")
    exact = all_of.join(some.distinct(), "order_id", "left_semi")
    assert exact.exceptAll(kept).count() == 0
    assert kept.columns == all_of.columns
    assert kept.count() <= exact.count() * 1.01 + 5 < all_of.count() / 10
    # and the plan sums payments only above the filter
    text = cluster_plan(spark, lambda: temporal.peak_weeks(mk, P))
    assert "bit_get" in text
    whole = temporal.peak_weeks(mk, P.with_(slice_filter_bits=0)).collect()
    assert temporal.peak_weeks(mk, P).collect() == whole


def test_filter_edges(spark):
    parent = spark.createDataFrame([("a",), (None,), ("a",)], "k string")
    child = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("b", 3)], "k string, v int")
    assert sorted(map(tuple, keep_matching(child, parent, "k").collect())) == [("a", 1), ("a", 1)]
    # crowded: with very few bits others stay too, but no match is lost
    many = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    kept = keep_matching(many, many.where("k % 3 = 0"), "k", bits=15)
    assert kept.where("k % 3 = 0").count() == many.where("k % 3 = 0").count()
    assert keep_matching(child, parent.where("k = 'z'"), "k").count() == 0
    assert keep_matching(child.limit(0), parent, "k").count() == 0


def test_approximate_median_rank(spark):
    from tianguis.operators.stats import exact_median, median, summary_stats

    n = 200_001
    df = spark.range(n).select(((F.col("id") * 7919) % n).cast("decimal(18,2)").alias("x")).repartition(50)
    about = float(median(df, "x", 2048).first()[0])
    assert abs(about / n - 0.5) < 2 / 2048
    assert float(exact_median(df, "x").first()[0]) == (n - 1) / 2
    s = summary_stats(df, "x", 2048).first()
    assert (s["mean"], s["min"], s["max"]) == ((n - 1) / 2, 0, n - 1)
    assert median(df.limit(0), "x", 2048).first()[0] is None
    mk = from_tpch(spark, SF)
    exact, sketched = (PLANS["f2_ticket_stats"](mk, P.with_(approximate_quantiles=a)).first() for a in (False, True))
    assert abs(sketched.ticket_mediana / exact.ticket_mediana - 1) < 0.05
    assert (sketched.ticket_promedio, sketched.ticket_maximo) == (exact.ticket_promedio, exact.ticket_maximo)
