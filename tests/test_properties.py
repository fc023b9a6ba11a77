"""Properties: shares add up, bands partition their input, exact order
statistics equal brute force, results do not depend on partitioning."""

import math
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from tianguis.operators.stats import exact_median, exact_top_sum
from tianguis.params import FIXTURE_PARAMS as P
from tianguis.plans import geo, quality, sellers
from tianguis.plans.registry import fixture_marketplace
from tianguis.sources.model import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mk(spark):
    return fixture_marketplace(spark, SF)


def _col(df, c):
    return [r[c] for r in df.collect()]


@pytest.mark.parametrize("name,col,digits", [
    ("f1_status_dist", "porcentaje", 2), ("f3_weekday", "pct_pedidos", 1), ("f3_hour", "pct_pedidos", 1),
    ("f5_delivery_hist", "pct_pedidos", 1), ("f5_seller_segments", "pct_sellers", 1),
    ("f4_state_revenue", "pct_revenue", 1), ("f2_payment_mix", "pct_revenue", 1),
])
def test_shares_sum_to_100(spark, name, col, digits):
    vals = _col(E.queries()[name](spark, SF), col)
    assert abs(sum(vals) - 100) <= len(vals) * 0.5 * 10 ** -digits + 1e-9


def test_last_cumulative_share_is_100(spark, mk):
    vals = sorted(_col(geo.pareto_states(mk, P), "pct_acumulado"))
    assert vals[-1] == 100.0 and vals == sorted(vals)


def test_bands_partition_the_filtered_orders(spark, mk):
    total = quality.late_delivery_summary(mk, P).collect()[0]
    stats = sellers.delivery_stats(mk, P).collect()[0]
    hist = sum(_col(sellers.delivery_histogram(mk, P), "pedidos"))
    scoped = mk.orders.where((F.col("order_status") == P.scope_status)
                             & F.col("order_delivered_customer_date").isNotNull()).count()
    assert hist == scoped
    late = sum(_col(quality.late_delay_buckets(mk, P), "cantidad"))
    assert late == total["entregas_tardias"] == stats["entregas_tardias"]


def test_anti_plus_matched_is_parent_count(spark, mk):
    missing = quality.orders_without_items(mk, P).collect()[0][0]
    matched = mk.orders.join(mk.items.select("order_id").distinct(), "order_id", "left_semi").count()
    assert missing + matched == mk.orders.count()


def test_top_k_is_prefix_of_full_ranking(spark, mk):
    top = [(r["categoria"], r["revenue"]) for r in geo.top_categories_by_revenue(mk, P).collect()]
    full = [(r["categoria"], r["revenue"]) for r in geo.category_mart(mk, P).collect()]
    full.sort(key=lambda t: (-t[1], t[0]))
    assert sorted(top, key=lambda t: (-t[1], t[0])) == full[: len(top)]


@pytest.mark.parametrize("name", ["f4_state_revenue", "f5_seller_scorecard", "f3_monthly_mart",
                                  "f2_ticket_stats", "x_top_decile_share", "f5_late_vs_score"])
def test_results_do_not_depend_on_partitioning(spark, mk, name):
    from tianguis.plans.registry import PLANS

    def spread(n):
        return mk.replace(**{f: mk.table(f).repartition(n) for f in TABLES})

    a = sorted(map(tuple, PLANS[name](spread(1), P).collect()), key=repr)
    b = sorted(map(tuple, PLANS[name](spread(7), P).collect()), key=repr)
    assert a == b


def _brute_median(xs):
    s = sorted(xs)
    n = len(s)
    return (s[(n + 1) // 2 - 1] + s[n // 2]) / 2


values = st.lists(st.integers(min_value=-50, max_value=50), min_size=0, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=values)
def test_exact_median_equals_brute_force(spark, xs):
    df = spark.createDataFrame([(Decimal(x) / 4,) for x in xs], "v decimal(18,2)")
    got = exact_median(df, "v").collect()[0]["median"]
    if not xs:
        assert got is None
    else:
        assert Decimal(str(got)) == Decimal(str(_brute_median([Decimal(x) / 4 for x in xs])))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=values, frac=st.sampled_from([0.1, 0.25, 0.5, 0.9]))
def test_exact_top_sum_equals_brute_force(spark, xs, frac):
    df = spark.createDataFrame([(Decimal(x),) for x in xs], "v decimal(18,2)")
    r = exact_top_sum(df, "v", frac).collect()[0]
    k = math.ceil(len(xs) * frac)
    assert r["n"] == len(xs) and r["k"] == k
    expected = sum(sorted(xs, reverse=True)[:k]) if xs else 0
    assert Decimal(r["top_sum"] or 0) == Decimal(expected)


def test_hot_value_collapses_in_the_bracket(spark):
    # a third of the rows share one value: the histogram holds one row for it
    xs = [7] * 400 + list(range(800))
    df = spark.createDataFrame([(Decimal(x),) for x in xs], "v decimal(18,2)")
    assert exact_median(df, "v").collect()[0]["median"] == Decimal(_brute_median(xs))


wide = st.lists(st.integers(min_value=-10**8, max_value=10**8), min_size=1, max_size=80)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=wide, frac=st.sampled_from([0.1, 0.5]))
def test_order_statistics_across_many_buckets(spark, xs, frac):
    vals = [Decimal(x) / 100 for x in xs]                      # cents up to +-1,000,000.00
    df = spark.createDataFrame([(v,) for v in vals], "v decimal(18,2)")
    assert Decimal(str(exact_median(df, "v").collect()[0]["median"])) == Decimal(str(_brute_median(vals)))
    k = math.ceil(len(vals) * frac)
    r = exact_top_sum(df, "v", frac).collect()[0]
    assert Decimal(r["top_sum"]) == sum(sorted(vals, reverse=True)[:k])
