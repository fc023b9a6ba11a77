"""Plan shape: anti joins for orphan checks, no cartesian products, windows
only above aggregates, filters and column pruning reaching the scan."""

import re

import pytest

import __spark_entry__ as E
from tianguis.params import FIXTURE_PARAMS as P
from tianguis.plans import quality, temporal
from tianguis.plans.registry import PLANS, fixture_marketplace

SF = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def mk(spark):
    return fixture_marketplace(spark, SF)


def test_orphan_checks_are_anti_joins(mk):
    for plan in (quality.orphan_items, quality.orphan_payments, quality.orphan_reviews,
                 quality.orders_without_payment):
        text = optimized(plan(mk, P))
        assert "LeftAnti" in text and "LeftOuter" not in text


@pytest.mark.parametrize("name", sorted(PLANS))
def test_no_cartesian_products(spark, name):
    text = physical(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def _window_inputs(plan_text: str):
    lines = plan_text.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line):
            depth = len(line) - len(line.lstrip(" :+-"))
            sub = []
            for nxt in lines[i + 1:]:
                d = len(nxt) - len(nxt.lstrip(" :+-"))
                if d <= depth:
                    break
                sub.append(nxt)
            yield "\n".join(sub)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_windows_only_over_aggregates(spark, name):
    for sub in _window_inputs(optimized(E.queries()[name](spark, SF))):
        assert "Aggregate" in sub


def test_scope_filter_and_pruning_reach_the_scan(spark, mk, tmp_path):
    """Over stored marketplace tables (the derived ones compute the status)."""
    mk.orders.write.parquet(f"{tmp_path}/orders")
    mk = mk.replace(orders=spark.read.parquet(f"{tmp_path}/orders"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    text = physical(temporal.monthly(mk, P))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(order_status,delivered\)", text)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(order_purchase_timestamp", text)
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", physical(quality.status_distribution(mk, P)))
    assert scans == ["order_status:string"]
