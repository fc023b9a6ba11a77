"""Registry of all analysis plans, keyed as in the coverage checklist."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from tianguis.params import FIXTURE_PARAMS, Params
from tianguis.plans import core, extras, geo, quality, sellers, temporal
from tianguis.sources.fixture import from_tpch
from tianguis.sources.model import Marketplace

Plan = Callable[[Marketplace, Params], DataFrame]

PLANS: dict[str, Plan] = {
    # phase 1 — quality
    "f1_row_counts": quality.row_count_report,
    "f1_dup_orders": quality.duplicate_orders,
    "f1_dup_customers": quality.duplicate_customers,
    "f1_unique_customers": quality.unique_customers,
    "f1_nulls_orders": quality.order_nulls,
    "f1_nulls_products": quality.product_nulls,
    "f1_nulls_reviews": quality.review_nulls,
    "f1_orphan_items": quality.orphan_items,
    "f1_orphan_payments": quality.orphan_payments,
    "f1_orphan_reviews": quality.orphan_reviews,
    "f1_status_dist": quality.status_distribution,
    "f1_payment_dist": quality.payment_distribution,
    "f1_no_payment": quality.orders_without_payment,
    "f1_no_review": quality.orders_without_review,
    "f1_no_items": quality.orders_without_items,
    "f1_late_summary": quality.late_delivery_summary,
    "f1_late_buckets": quality.late_delay_buckets,
    "f1_quality_summary": quality.quality_summary,
    # phase 2 — core metrics
    "f2_revenue_total": core.revenue_total,
    "f2_volume": core.order_volume,
    "f2_ticket_stats": core.ticket_stats,
    "f2_ticket_median_alt": core.ticket_median_by_rank,
    "f2_price_freight": core.price_and_freight,
    "f2_items_per_order": core.items_per_order_histogram,
    "f2_items_summary": core.items_summary,
    "f2_payment_mix": core.payment_mix,
    "f2_kpi_summary": core.kpi_summary,
    # phase 3 — time
    "f3_monthly": temporal.monthly,
    "f3_mom_growth": temporal.month_over_month,
    "f3_yoy": temporal.year_over_year,
    "f3_weekday": temporal.weekday_profile,
    "f3_hour": temporal.hour_profile,
    "f3_daypart": temporal.daypart_profile,
    "f3_peak_weeks": temporal.peak_weeks,
    "f3_monthly_mart": temporal.monthly_mart,
    # phase 4 — geography and products
    "f4_state_revenue": geo.state_revenue,
    "f4_pareto_states": geo.pareto_states,
    "f4_seller_state": geo.seller_state_revenue,
    "f4_state_balance": geo.state_balance,
    "f4_top_cat_revenue": geo.top_categories_by_revenue,
    "f4_top_cat_units": geo.top_categories_by_units,
    "f4_cat_quadrants": geo.category_quadrants,
    "f4_top_products": geo.top_products,
    "f4_geo_mart": geo.buyer_state_mart,
    "f4_cat_mart": geo.category_mart,
    # phase 5 — sellers and delivery
    "f5_delivery_stats": sellers.delivery_stats,
    "f5_delivery_hist": sellers.delivery_histogram,
    "f5_late_vs_score": sellers.late_vs_score,
    "f5_score_by_band": sellers.score_by_delivery_band,
    "f5_seller_segments": sellers.seller_segments,
    "f5_seller_scorecard": sellers.seller_scorecard,
    "f5_top_sellers": sellers.top_sellers,
    "f5_bottom_sellers": sellers.bottom_sellers,
    "f5_delivery_monthly": sellers.delivery_monthly_mart,
    "f5_scorecard_mart": sellers.seller_scorecard_mart,
    # figures stated in prose
    "x_delivery_median": extras.delivery_median,
    "x_top_decile_share": extras.top_seller_share,
    "x_top_n_share": extras.top_n_share,
}


@lru_cache(maxsize=4)
def fixture_marketplace(spark: SparkSession, sf_dir: str) -> Marketplace:
    """The marketplace derived from the test tables in ``sf_dir``, one set of table handles per
    session and folder. The mapping is lazy: a table is mapped when a plan first asks for it, and
    each query reads the given tables themselves, pruned to what it needs."""
    return from_tpch(spark, sf_dir)


def fixture_query(name: str, params: Params = FIXTURE_PARAMS) -> Callable[[SparkSession, str], DataFrame]:
    """(spark, sf_dir) -> DataFrame over the marketplace derived from the test tables."""
    plan = PLANS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(fixture_marketplace(spark, sf_dir), params)

    run.__name__ = name
    run.__doc__ = plan.__doc__
    return run
