"""Exact order statistics: one join in the plan, bounded rows in the last window."""

import random
import statistics

from pyspark.sql import functions as F

from tianguis.operators.distinct import count_two_distinct
from tianguis.operators.stats import exact_median, exact_top_sum, summary_stats
from tianguis.params import FIXTURE_PARAMS as P
from tianguis.plans import core, geo, temporal
from tianguis.plans.registry import fixture_marketplace

SF = "/root/testdata/sf0.001"


def test_median_and_top_sum_against_sorting(spark):
    rng = random.Random(5)
    for n in (1, 2, 3, 10, 501, 1000):
        xs = [rng.choice([rng.randint(-50, 50), rng.randint(-10**9, 10**9), 7]) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in xs], "x long")
        assert exact_median(df, "x").first().median == statistics.median(xs)
        t = exact_top_sum(df, "x", 0.1).first()
        k = -(-n // 10)
        assert (t.n, t.k, t.top_sum, t.total) == (n, k, sum(sorted(xs)[-k:]), sum(xs))
    empty = spark.createDataFrame([], "x long")
    assert exact_median(empty, "x").first().median is None
    assert tuple(exact_top_sum(empty, "x", 0.1).first()) == (0, 0, 0, None)
    assert tuple(summary_stats(empty, "x").first()) == (None, None, None, None)


def test_a_million_distinct_values_in_one_bucket(spark):
    """All in one logarithmic bucket; the cells cut it again, so the last window stays small."""
    low = 1 << 40
    df = spark.range(1_000_000).select((F.lit(low) + F.col("id")).alias("x"))
    assert exact_median(df, "x").first().median == low + 499_999.5
    t = exact_top_sum(df, "x", 0.1).first()
    assert (t.k, t.top_sum) == (100_000, sum(range(low + 900_000, low + 1_000_000)))


def test_one_order_join_feeds_the_statistics(spark):
    mk = fixture_marketplace(spark, SF)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = core.ticket_stats(mk, P)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange" in plan
    assert plan.count("SortMergeJoin") == 1, plan


def test_two_distinct_counts_without_expand(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice([None, *range(9)]), rng.choice([None, *"xyz"]), 1) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, p long, q string, m long")
    got = {r.g: (r.ps, r.qs, r.m) for r in count_two_distinct(df, ["g"], ("p", "ps"), ("q", "qs"), ["m"]).collect()}
    want = {g: (len({p for a, p, _, _ in rows if a == g} - {None}), len({q for a, _, q, _ in rows if a == g} - {None}),
                sum(a == g for a, *_ in rows)) for g in "ab"}
    assert got == want
    mk = fixture_marketplace(spark, SF)
    for plan in (core.order_volume, temporal.monthly_mart, geo.state_revenue, geo.buyer_state_mart):
        assert "Expand" not in plan(mk, P)._jdf.queryExecution().executedPlan().toString()


def test_ratios_do_not_depend_on_the_order_of_rows(spark):
    mk = fixture_marketplace(spark, SF)

    def kpis(n):
        return core.kpi_summary(mk.replace(items=mk.items.repartition(n)), P).collect()

    assert kpis(1) == kpis(200)


def test_approximate_distinct_counts_are_an_option(spark):
    mk = fixture_marketplace(spark, SF)
    exact, about = (core.order_volume(mk, P.with_(approximate_distinct=a)).first() for a in (False, True))
    assert abs(about.clientes_unicos / exact.clientes_unicos - 1) < 0.15

    rows = temporal.monthly_mart(mk, P.with_(approximate_distinct=True))
    assert rows.columns == temporal.monthly_mart(mk, P).columns
