"""Every plan runs on an empty marketplace (no division-by-zero errors, no
failed order statistics); global aggregates return their single NULL/0 row,
grouped reports return no rows."""

import pytest

from helpers import marketplace
from tianguis.params import Params
from tianguis.plans.registry import PLANS

GLOBAL = {"f1_unique_customers", "f1_nulls_orders", "f1_nulls_products", "f1_nulls_reviews",
          "f1_orphan_items", "f1_orphan_payments", "f1_orphan_reviews", "f1_no_payment", "f1_no_review",
          "f1_no_items", "f1_late_summary", "f2_revenue_total", "f2_volume", "f2_ticket_stats",
          "f2_ticket_median_alt", "f2_price_freight", "f2_items_summary", "f5_delivery_stats",
          "x_delivery_median", "x_top_decile_share"}


@pytest.fixture(scope="module")
def empty(spark):
    return marketplace(spark)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_plan_runs_on_empty_input(spark, empty, name):
    rows = PLANS[name](empty, Params()).collect()
    if name in GLOBAL:
        assert len(rows) == 1
    elif name == "f1_row_counts":
        assert [r["total_filas"] for r in rows] == [0] * 7
    elif name in ("f1_quality_summary", "f2_kpi_summary"):
        assert len(rows) == 7
    elif name == "x_top_n_share":
        assert [r["top_n"] for r in rows] == [0, 0]
    else:
        assert rows == []
