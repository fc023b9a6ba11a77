"""The runner loads stored tables with the declared schemas and writes results."""

import tempfile

from tianguis.cli import _params, _table_paths, run
from tianguis.params import FIXTURE_PARAMS
from tianguis.plans.registry import PLANS, fixture_marketplace


def test_runner_over_stored_tables(spark):
    mk = fixture_marketplace(spark, "/root/testdata/sf0.001")
    d = tempfile.mkdtemp(prefix="tianguis-cli-", dir="/tmp")
    names = {"orders": mk.orders, "order_items": mk.items, "order_payments": mk.payments,
             "customers": mk.customers, "order_reviews": mk.reviews, "products": mk.products,
             "sellers": mk.sellers, "category_translation": mk.translation}
    for name, df in names.items():
        df.write.parquet(f"{d}/tables/{name}")
    p = _params(["analysis_start=1996-01-01", "compare_years=1999,2000", "quadrant_price=53000",
                 "quadrant_units=2200"])
    assert p.compare_years == (1999, 2000) and p.quadrant_units == 2200
    assert _params(["quadrant_price=129.5"]).quadrant_price == 129.5
    assert set(_table_paths(spark, f"file://{d}/tables", "parquet")) == set(names)
    mk.translation.write.parquet(f"{d}/suffix/category_translation.parquet")
    assert _table_paths(spark, f"file://{d}/suffix", "parquet") == {
        "category_translation": f"file://{d}/suffix/category_translation.parquet"}
    done = run(spark, f"{d}/tables", f"{d}/out", queries=["f3_monthly", "f5_seller_scorecard"], params=p,
               output_format="csv")
    assert done == ["f3_monthly", "f5_seller_scorecard"]
    got = spark.read.option("header", True).csv(f"{d}/out/f3_monthly")
    expected = PLANS["f3_monthly"](mk, FIXTURE_PARAMS)
    assert got.count() == expected.count()
    # ids are loaded as strings (the declared schema), values unchanged
    sc = spark.read.option("header", True).csv(f"{d}/out/f5_seller_scorecard")
    assert sorted(r["seller_id"] for r in sc.collect()) == sorted(
        str(r["seller_id"]) for r in PLANS["f5_seller_scorecard"](mk, FIXTURE_PARAMS).collect())
