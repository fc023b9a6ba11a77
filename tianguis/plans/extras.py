"""Figures the original analyses state in prose, computed here from the data:
the median delivery time, the revenue share of the top seller decile, and the
share of the first N states and categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tianguis.functions.numeric import pct, round_half_up
from tianguis.operators.ranking import top_k
from tianguis.operators.shares import grand_total
from tianguis.operators.stats import exact_top_sum, median
from tianguis.params import Params
from tianguis.plans import geo, sellers
from tianguis.plans.common import delivery_days
from tianguis.sources.model import Marketplace


def delivery_median(mk: Marketplace, p: Params) -> DataFrame:
    """Exact median of purchase-to-delivery days over the delivery-stats scope."""
    days = sellers._delivered(mk, p, need_estimate=True).select(delivery_days().alias("d"))
    return median(days, "d", p.quantile_k).select(round_half_up("median", 1).alias("dias_entrega_mediana"))


def top_seller_share(mk: Marketplace, p: Params) -> DataFrame:
    """Share of revenue earned by the top ``top_seller_fraction`` of sellers
    (k = ceil(fraction * sellers), ranked by rounded seller revenue)."""
    t = exact_top_sum(sellers.seller_revenue(mk, p), "revenue", p.top_seller_fraction)
    return t.select(F.col("n").alias("sellers_total"), F.col("k").alias("sellers_top"),
                    F.col("top_sum").cast("double").alias("revenue_top"),
                    round_half_up(pct("top_sum", "total"), 1).alias("pct_revenue_top"))


def _top_n_share(df: DataFrame, key: str, measure: str, n: int, label: str) -> DataFrame:
    """``df`` holds one row per group of a bounded key set (states, categories)."""
    with_total = df.select(key, measure, grand_total(measure).alias("_total"))
    top = top_k(with_total, [F.col(measure).desc(), F.col(key).asc()], n)
    return top.agg(F.sum(measure).alias("_top"), F.count(F.lit(1)).alias("top_n"),
                   F.max("_total").alias("_total")).select(
        F.lit(label).alias("dimension"), F.col("top_n").cast("bigint").alias("top_n"),
        round_half_up(pct("_top", "_total"), 1).alias("pct_revenue"))


def top_n_share(mk: Marketplace, p: Params) -> DataFrame:
    """Revenue share of the first N buyer states (payment revenue) and of the
    first N categories (item price revenue)."""
    states = geo._buyer_state_revenue(mk, p, "revenue")
    cats = geo._category_base(mk, p).select("categoria", F.col("sp").alias("revenue"))
    return reduce(DataFrame.unionByName, [
        _top_n_share(states, "estado", "revenue", p.top_n_share, "estado"),
        _top_n_share(cats, "categoria", "revenue", p.top_n_share, "categoria"),
    ])
