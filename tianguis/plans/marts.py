"""BI marts: the tables the dashboards import, written as Parquet or CSV.

The five marts of the original analyses (monthly trend, buyer states,
categories, monthly delivery performance, seller scorecard) are written by
the executors straight to the target folder; nothing is collected.

``export_marts`` computes them from the whole tables. ``refresh_marts`` keeps, for
each mart, the additive measures it is made of, one slice per purchase month: a refresh
computes some months only, puts them in place of the old ones, and shows the marts from all slices.
Distinct buyers of a state do not add up over months, so they are kept as HLL sketches, which do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tianguis.functions.dates import year_month
from tianguis.operators.distinct import count_two_distinct
from tianguis.operators.periods import in_window
from tianguis.operators.reduction import keep_matching
from tianguis.params import Params
from tianguis.plans import geo, sellers, temporal
from tianguis.plans.common import PTS
from tianguis.session import shared_dir
from tianguis.sources.model import Marketplace
from tianguis.sources.sinks import Slices, write_mart

MARTS = {
    "monthly": temporal.monthly_mart,
    "states": geo.buyer_state_mart,
    "categories": geo.category_mart,
    "delivery_monthly": sellers.delivery_monthly_mart,
    "seller_scorecard": sellers.seller_scorecard_mart,
}

MONTH = "mes"
#: Slice of the orders without a purchase time.
NO_MONTH = "none"
#: Size of the sketches of distinct buyers: 2**12 registers, a relative error of about 1.6 %.
SKETCH_BITS = 12


def export_marts(mk: Marketplace, p: Params, out_dir: str, fmt: str = "parquet",
                 names: list[str] | None = None) -> list[str]:
    """Write the selected marts (all by default) under ``out_dir/<name>``."""
    written = []
    for name in names or list(MARTS):
        path = f"{out_dir}/{name}"
        write_mart(MARTS[name](mk, p), path, fmt)
        written.append(path)
    return written


@dataclass(frozen=True)
class Refreshable:
    """A mart as additive rows per month (``sums``) and what is shown of all of them (``shown``)."""

    sums: Callable[[Marketplace, Params], DataFrame]
    shown: Callable[[DataFrame, Marketplace, Params], DataFrame]


def _month_sums(mk: Marketplace, p: Params) -> DataFrame:
    rows, keys = temporal.month_rows(mk, p)
    return count_two_distinct(rows, keys, ("order_id", "pedidos"), ("customer_id", "clientes"),
                              ["pay_sum", "pay_rows"], p.approximate_distinct)


def _state_sums(mk: Marketplace, p: Params) -> DataFrame:
    """An order has one month, so distinct orders add up over months; buyers are sketched."""
    return geo.paid_by_buyers(mk, p, MONTH).groupBy(MONTH, "estado").agg(
        F.countDistinct("order_id").alias("pedidos"), F.sum("pay_sum").alias("_rev"), F.sum("pay_rows").alias("_rows"),
        F.hll_sketch_agg("customer_unique_id", SKETCH_BITS).alias("buyers"))


def _states_shown(sums: DataFrame, mk: Marketplace, p: Params) -> DataFrame:
    g = sums.groupBy("estado").agg(F.sum("pedidos").alias("pedidos"), F.sum("_rev").alias("_rev"), F.sum("_rows").alias("_rows"),
                                   F.hll_sketch_estimate(F.hll_union_agg("buyers")).alias("clientes_unicos"))
    return geo.buyer_states_shown(g)


def _categories_shown(sums: DataFrame, mk: Marketplace, p: Params) -> DataFrame:
    names = sums.groupBy("product_category_name").agg(*[F.sum(c).alias(c) for c in geo.CATEGORY_SUMS])
    return geo.categories_shown(geo.by_label(names, mk))


def _scorecard_shown(sums: DataFrame, mk: Marketplace, p: Params) -> DataFrame:
    per_seller = sums.groupBy("seller_id").agg(*[F.sum(c).alias(c) for c in ("pedidos", *sellers.SELLER_SUMS)])
    return sellers.seller_scorecard_mart(mk, p, sellers.located(per_seller, mk))


REFRESHABLE = {
    "monthly": Refreshable(_month_sums, lambda sums, mk, p: temporal.months_shown(sums)),
    "states": Refreshable(_state_sums, _states_shown),
    "categories": Refreshable(lambda mk, p: geo.category_sums(mk, p, (MONTH,)), _categories_shown),
    "delivery_monthly": Refreshable(sellers.delivery_sums, lambda sums, mk, p: sellers.deliveries_shown(sums)),
    "seller_scorecard": Refreshable(lambda mk, p: sellers.seller_sums(mk, p, (MONTH,)), _scorecard_shown),
}


def _span(months: list[str]) -> Column:
    """The time range of ``months`` on the raw timestamp, which the scan can use to skip row groups."""
    dated = sorted(m for m in months if m != NO_MONTH)
    unknown = F.col(PTS).isNull() if NO_MONTH in months else F.lit(False)
    if not dated:
        return unknown
    year, month = map(int, dated[-1].split("-"))
    after = f"{year + month // 12:04d}-{month % 12 + 1:02d}-01"
    return in_window(PTS, f"{dated[0]}-01", after) | unknown


def of_months(mk: Marketplace, p: Params, months: list[str] | None) -> Marketplace:
    """The marketplace with the month of each order, and with ``months`` only their orders and
    what may belong to these: items, payments and reviews of other orders are left out before any shuffle."""
    orders = mk.orders.withColumn(MONTH, F.coalesce(year_month(PTS), F.lit(NO_MONTH)))
    if months is None:
        return mk.replace(orders=orders)
    orders = orders.where(F.col(MONTH).isin(months) & _span(months))
    if not p.slice_filter_bits:
        return mk.replace(orders=orders)

    def mine(child: DataFrame) -> DataFrame:
        return keep_matching(child, orders.select("order_id"), "order_id", p.slice_filter_bits)

    return mk.replace(orders=orders, items=lambda: mine(mk.items), payments=lambda: mine(mk.payments), reviews=lambda: mine(mk.reviews))


def refresh_marts(mk: Marketplace, p: Params, out_dir: str, months: list[str] | None = None,
                  fmt: str = "parquet", names: list[str] | None = None) -> list[str]:
    """Bring the selected marts under ``out_dir/<name>`` up to date after the orders of ``months``
    ('YYYY-MM', or 'none' for orders without a purchase time; None: all months) have changed.

    Only these months are computed. Their sums replace the old slices under ``out_dir/_sums/<name>``, and
    the marts are written again from all slices; both writes are staged, so after a failure the old
    slices or marts are still there and the refresh can be run again. Refreshing a month gives what a
    refresh of all months gives. Names of states and categories are those of the time when a month was last computed;
    category labels and seller states are looked up anew. Distinct buyers of a state are estimates
    (sketches); all other figures are exact."""
    spark = mk.orders.sparkSession
    part = of_months(mk, p, months)
    written = []
    for name in names or list(REFRESHABLE):
        mart = REFRESHABLE[name]
        kept = Slices(spark, f"{out_dir}/_sums/{name}", MONTH)
        kept.replace(mart.sums(part, p), months)
        write_mart(mart.shown(kept.read(), mk, p), f"{out_dir}/{name}", fmt)
        written.append(f"{out_dir}/{name}")
    return written


def seller_report(mk: Marketplace, p: Params) -> dict[str, DataFrame]:
    """Scorecard, top and bottom sellers and the scorecard mart from one
    computation of the per-seller base. The base (one row per seller) is
    checkpointed to the session's checkpoint folder (the cluster's shared
    ``spark.checkpoint.dir``), so the four outputs read it instead of
    re-joining items, orders and reviews, and a lost executor does not
    recompute the join."""
    shared_dir(mk.orders.sparkSession)           # checkpoint folder: the cluster's shared one
    base = sellers.seller_performance(mk, p).checkpoint(eager=True)
    return {
        "scorecard": sellers.seller_scorecard(mk, p, base),
        "top": sellers.top_sellers(mk, p, base),
        "bottom": sellers.bottom_sellers(mk, p, base),
        "mart": sellers.seller_scorecard_mart(mk, p, base),
    }
