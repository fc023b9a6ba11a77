"""Outputs at sf0.01 equal the facts FIXTURES.md §2.2 reports for the derived data."""

import os
from collections import Counter

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/orders.parquet"), reason="test data not present")


def test_fixture_facts(spark):
    q = E.queries()
    st = {r.order_status: r.cantidad for r in q["f1_status_dist"](spark, SF).collect()}
    assert st == {"delivered": 14022, "canceled": 375, "shipped": 643}
    late = [(r.rango_retraso, r.cantidad) for r in q["f1_late_buckets"](spark, SF).collect()]
    assert late == [(None, 296), ("1-3 días", 572), ("4-7 días", 616), ("8-15 días", 333), ("más de 15 días", 386)]
    assert [r.pedidos for r in q["f5_delivery_hist"](spark, SF).collect()] == [3376, 2940, 2925, 3728, 1023]
    assert [r.sellers for r in q["f5_seller_segments"](spark, SF).collect()] == [1447, 351, 100, 100]
    classes = Counter(r.clasificacion for r in q["f5_seller_scorecard"](spark, SF).collect())
    assert classes == {"Top performer": 16, "Buen performance": 199, "Performance medio": 255,
                       "Requiere atención": 4}
    missing = [q[k](spark, SF).collect()[0][0] for k in ("f1_no_payment", "f1_no_review", "f1_no_items")]
    assert missing == [45, 205, 316]
    orphans = [q[k](spark, SF).collect()[0][0] for k in ("f1_orphan_items", "f1_orphan_payments", "f1_orphan_reviews")]
    assert orphans == [59, 30, 38]
    assert [q[k](spark, SF).count() for k in ("f1_dup_orders", "f1_dup_customers")] == [40, 24]
