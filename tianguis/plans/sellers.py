"""Phase 5 — delivery performance and sellers: delivery-time statistics and
bands, late delivery vs review score, seller segments, seller scorecards,
best/worst sellers, monthly delivery mart.

Reviews are consolidated per order (row count, score sum, score count,
count per score) before they meet orders or items. The original joins keep the
fan-out of items x reviews (an order with two reviews counts each of its items
twice in sums, means and the late-% denominator); the consolidated form
reproduces that exactly by weighting each item row with its order's review
count, without materialising the fan-out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tianguis.functions import labels as L
from tianguis.functions.dates import year_month
from tianguis.functions.numeric import pct, round_dec, round_half_up, safe_div
from tianguis.functions.rules import bucketize, classify
from tianguis.operators.periods import in_window
from tianguis.operators.ranking import top_k
from tianguis.operators.shares import distribution, share_of_total
from tianguis.params import Params, SellerCuts
from tianguis.plans.common import DELIVERED_AT, ESTIMATED_AT, PTS, delivery_days, flag, is_late
from tianguis.sources.model import Marketplace


def _delivered(mk: Marketplace, p: Params, need_estimate: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    cond = (F.col("order_status") == p.scope_status) & F.col(DELIVERED_AT).isNotNull()
    if need_estimate:
        cond = cond & F.col(ESTIMATED_AT).isNotNull()
    return mk.orders.where(cond).select("order_id", PTS, DELIVERED_AT, ESTIMATED_AT, *by)


def reviews_per_order(mk: Marketplace, parts: int = 0) -> DataFrame:
    s = F.col("review_score")
    return _dealt(mk.reviews.select("order_id", s), parts).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_rev"),
        F.sum(s).alias("score_sum"), F.count(s).alias("score_n"),
        *[F.count(F.when(s == k, F.lit(1))).alias(f"score_{k}") for k in (5, 4, 3, 2, 1)])


# ------------------------------------------------------------ delivery times
def delivery_stats(mk: Marketplace, p: Params) -> DataFrame:
    o = _delivered(mk, p, need_estimate=True)
    d = delivery_days()
    late_dev = F.when(is_late(), F.datediff(F.col(DELIVERED_AT), F.col(ESTIMATED_AT)))
    a = o.agg(F.sum(d).alias("_ds"), F.count(d).alias("_dn"), F.min(d).alias("_dmin"), F.max(d).alias("_dmax"),
              F.count(F.lit(1)).alias("total_entregados"),
              F.sum(flag(is_late())).cast("bigint").alias("entregas_tardias"),
              F.sum(late_dev).alias("_ls"), F.count(late_dev).alias("_ln"))
    return a.select(round_half_up(safe_div("_ds", "_dn"), 1).alias("dias_entrega_promedio"),
                    F.col("_dmin").cast("bigint").alias("dias_entrega_minimo"),
                    F.col("_dmax").cast("bigint").alias("dias_entrega_maximo"),
                    "total_entregados", "entregas_tardias",
                    round_half_up(pct("entregas_tardias", "total_entregados"), 1).alias("pct_tardias"),
                    round_half_up(safe_div("_ls", "_ln"), 1).alias("desvio_prom_tardias"))


def _delivery_band(p: Params):
    return bucketize(delivery_days(), p.delivery_bands, p.delivery_band_other)


def delivery_histogram(mk: Marketplace, p: Params) -> DataFrame:
    """Orders per delivery-time band (grouped by band)."""
    return (distribution(_delivered(mk, p), [_delivery_band(p).alias("rango_entrega")],
                         {"pedidos": F.count(F.lit(1))}, [("pedidos", "pct_pedidos", 1)])
            .orderBy("rango_entrega"))


def late_vs_score(mk: Marketplace, p: Params) -> DataFrame:
    """On-time vs late (a NULL comparison counts as late, as the CASE ELSE
    does; both dates are non-NULL here anyway) against review scores."""
    o = _delivered(mk, p, need_estimate=True).join(reviews_per_order(mk), "order_id", "inner")
    kind = F.when(F.col(DELIVERED_AT) <= F.col(ESTIMATED_AT), F.lit(L.ON_TIME)).otherwise(F.lit(L.LATE))
    g = o.groupBy(kind.alias("tipo_entrega")).agg(
        F.countDistinct("order_id").alias("pedidos"),
        F.sum("score_sum").alias("_ss"), F.sum("score_n").alias("_sn"),
        *[F.sum(f"score_{k}").cast("bigint").alias(f"score_{k}") for k in (5, 4, 3, 2, 1)])
    return g.select("tipo_entrega", "pedidos", round_half_up(safe_div("_ss", "_sn"), 2).alias("score_promedio"),
                    *[f"score_{k}" for k in (5, 4, 3, 2, 1)])


def score_by_delivery_band(mk: Marketplace, p: Params) -> DataFrame:
    o = _delivered(mk, p).join(reviews_per_order(mk), "order_id", "inner")
    g = o.groupBy(_delivery_band(p).alias("rango_entrega")).agg(
        F.countDistinct("order_id").alias("pedidos"),
        F.sum("score_sum").alias("_ss"), F.sum("score_n").alias("_sn"))
    return (g.select("rango_entrega", "pedidos",
                     round_half_up(safe_div("_ss", "_sn"), 2).alias("score_promedio"))
            .orderBy("rango_entrega"))


def delivery_monthly_mart(mk: Marketplace, p: Params) -> DataFrame:
    """Per purchase month; orders LEFT JOIN reviews, so each order weighs as
    many rows as it has reviews (at least one)."""
    return deliveries_shown(delivery_sums(mk, p))


def delivery_sums(mk: Marketplace, p: Params) -> DataFrame:
    """Additive delivery measures per purchase month."""
    o = (_delivered(mk, p).where(in_window(PTS, p.analysis_start))
         .join(reviews_per_order(mk).select("order_id", "n_rev", "score_sum", "score_n"), "order_id", "left"))
    w = F.coalesce(F.col("n_rev"), F.lit(1))
    d = delivery_days()
    return o.groupBy(year_month(PTS).alias("mes")).agg(
        F.sum(w).alias("total_entregas"),
        F.sum(F.when(d.isNotNull(), d * w)).alias("_ds"), F.sum(F.when(d.isNotNull(), w)).alias("_dn"),
        F.sum(flag(is_late()) * w).alias("_late"),
        F.sum("score_sum").alias("_ss"), F.sum("score_n").alias("_sn"))


def deliveries_shown(g: DataFrame) -> DataFrame:
    return (g.select("mes", F.col("total_entregas").cast("bigint").alias("total_entregas"),
                     round_half_up(safe_div("_ds", "_dn"), 1).alias("dias_entrega_prom"),
                     round_half_up(pct("_late", "total_entregas"), 1).alias("pct_tardias"),
                     round_half_up(safe_div("_ss", "_sn"), 2).alias("score_prom"))
            .orderBy("mes"))


# ------------------------------------------------------------------- sellers
def _order_parts(mk: Marketplace, p: Params) -> int:
    """Partitions by order_id in which a task gets about ``items_per_task`` items, whatever the number of
    items and the session's settings; (order, seller) groups are nearly as many as items, so this bounds the memory of a
    task. 0 leaves the partitions to Spark: few items, or tables bucketed by order_id."""
    if not p.items_per_task or mk.bucketed:
        return 0
    parts = -(-mk.rows("items") // p.items_per_task)
    return max(parts, mk.items.sparkSession.sparkContext.defaultParallelism) if parts > 1 else 0


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    """Rows with an order id in ``parts`` partitions by it, as the joins need them; 0 leaves that to Spark."""
    return df.where(F.col("order_id").isNotNull()).repartition(parts, "order_id") if parts else df


def _sold(mk: Marketplace, orders: DataFrame, *cols: str, parts: int = 0) -> DataFrame:
    """Items (order_id, seller_id, ``cols``) of ``orders``. Both sides are hashed on order_id
    once; the join's partitioning also serves a grouping by (order_id, seller_id) above it. Items
    without an order id never match and are dropped before the exchange."""
    items = mk.items.select("order_id", "seller_id", *cols)
    return _dealt(items, parts).join(_dealt(orders, parts), "order_id", "inner")


def _scope_ids(mk: Marketplace, p: Params) -> DataFrame:
    return mk.orders.where(F.col("order_status") == p.scope_status).select("order_id")


def seller_revenue(mk: Marketplace, p: Params) -> DataFrame:
    """(seller_id, revenue rounded to cents) over delivered orders: sums only, which
    collapse per task before the exchange by seller."""
    return (_sold(mk, _scope_ids(mk, p), "price", parts=_order_parts(mk, p)).groupBy("seller_id")
            .agg(round_dec(F.sum("price"), 2).alias("revenue")))


def _seller_orders(mk: Marketplace, p: Params) -> DataFrame:
    """Per seller over delivered orders: distinct orders and exact revenue. Orders are
    counted as (order, seller) groups, formed where the join left the rows."""
    pairs = (_sold(mk, _scope_ids(mk, p), "price", parts=_order_parts(mk, p)).groupBy("order_id", "seller_id")
             .agg(F.sum("price").alias("price_sum")))
    return pairs.groupBy("seller_id").agg(F.count("order_id").alias("pedidos"),
                                          round_dec(F.sum("price_sum"), 2).alias("revenue"))


def seller_segments(mk: Marketplace, p: Params) -> DataFrame:
    """Sellers by delivered-order count (items joined to orders; the sellers
    table is not needed)."""
    g = (_seller_orders(mk, p)
         .groupBy(bucketize("pedidos", p.seller_segments, p.seller_segment_other).alias("segmento"))
         .agg(F.count(F.lit(1)).alias("sellers"), F.sum("revenue").alias("_rev")))
    g = share_of_total(g, "sellers", "pct_sellers", 1)
    g = share_of_total(g, "_rev", "pct_revenue", 1)
    return g.select("segmento", "sellers", "pct_sellers", round_half_up("_rev", 2).alias("revenue_total"),
                    "pct_revenue").orderBy("segmento")


#: Additive measures of a seller; every scorecard figure is a ratio of two of them.
SELLER_SUMS = ("rows", "price_sum", "price_n", "score_sum", "score_n", "days_sum", "days_n", "late")


def seller_sums(mk: Marketplace, p: Params, by: tuple[str, ...] = ()) -> DataFrame:
    """Per seller (and further columns of its orders): distinct orders and the sums of
    ``SELLER_SUMS``. Rows are the items of delivered orders with a delivery date x reviews of the
    order (at least one row per item), as weights: an item stands for as many rows as its order has
    reviews. Items, orders and reviews per order meet on order_id; (order, seller) groups are formed
    there without another exchange."""
    parts = _order_parts(mk, p)
    fact = (_sold(mk, _delivered(mk, p, by=by), "price", parts=parts)
            .join(reviews_per_order(mk, parts).select("order_id", "n_rev", "score_sum", "score_n"), "order_id", "left"))
    w = F.lit(1) if p.one_review_row_per_item else F.coalesce(F.col("n_rev"), F.lit(1))
    d = delivery_days()
    pairs = fact.groupBy("order_id", "seller_id", *by).agg(
        F.sum(w).alias("rows"),
        F.sum(F.col("price") * w).alias("price_sum"),
        F.sum(F.when(F.col("price").isNotNull(), w)).alias("price_n"),
        F.sum("score_sum").alias("score_sum"),
        F.sum("score_n").alias("score_n"),
        F.sum(F.when(d.isNotNull(), d * w)).alias("days_sum"),
        F.sum(F.when(d.isNotNull(), w)).alias("days_n"),
        F.sum(flag(is_late()) * w).alias("late"))
    return pairs.groupBy("seller_id", *by).agg(F.count("order_id").alias("pedidos"),
                                               *[F.sum(c).alias(c) for c in SELLER_SUMS])


def located(per_seller: DataFrame, mk: Marketplace) -> DataFrame:
    """Seller sums with the seller's state, one row per (seller, state): a repeated seller
    row repeats the additive sums exactly as the row-level join would, and leaves the distinct
    order count unchanged."""
    s = mk.sellers.select("seller_id", "seller_state")
    return (per_seller.join(s, "seller_id", "inner").groupBy("seller_id", "seller_state")
            .agg(F.max("pedidos").alias("pedidos"), *[F.sum(c).alias(c) for c in SELLER_SUMS]))


def seller_performance(mk: Marketplace, p: Params) -> DataFrame:
    """Unfiltered scorecard base: one row per (seller, seller state) with the raw sums
    that the scorecards round."""
    return located(seller_sums(mk, p), mk)


def _rounded_scorecard(base: DataFrame) -> DataFrame:
    return base.select(
        "seller_id", "seller_state", "pedidos",
        round_half_up("price_sum", 2).alias("revenue"),
        round_half_up(safe_div("price_sum", "price_n"), 2).alias("precio_prom"),
        round_half_up(safe_div("score_sum", "score_n"), 2).alias("score_prom"),
        round_half_up(safe_div("days_sum", "days_n"), 1).alias("dias_entrega_prom"),
        round_half_up(pct("late", "rows"), 1).alias("pct_tardias"))


def seller_class(c: SellerCuts):
    score, late = F.col("score_prom"), F.col("pct_tardias")
    return classify([
        (L.SELLER_CLASS_TOP, (score >= c.top_score) & (late <= c.top_late)),
        (L.SELLER_CLASS_GOOD, (score >= c.good_score) & (late <= c.good_late)),
        (L.SELLER_CLASS_ATTENTION, (score < c.bad_score) | (late > c.bad_late)),
    ], L.SELLER_CLASS_MEDIUM)


def seller_scorecard(mk: Marketplace, p: Params, base: DataFrame | None = None) -> DataFrame:
    base = seller_performance(mk, p) if base is None else base
    sc = _rounded_scorecard(base.where(F.col("pedidos") >= p.scorecard_min_orders))
    return sc.withColumn("clasificacion", seller_class(p.seller_cuts)).orderBy(F.col("revenue").desc())


def _ranked(mk: Marketplace, p: Params, base: DataFrame | None) -> DataFrame:
    base = seller_performance(mk, p) if base is None else base
    return _rounded_scorecard(base.where(F.col("pedidos") >= p.scorecard_min_orders))


_RANK_COLS = ["ranking", "seller_id", "seller_state", "pedidos", "score_prom", "pct_tardias", "revenue"]


def top_sellers(mk: Marketplace, p: Params, base: DataFrame | None = None) -> DataFrame:
    sc = _ranked(mk, p, base)
    t = top_k(sc, [F.col("score_prom").desc_nulls_last(), F.col("pedidos").desc(), F.col("seller_id").asc()],
              p.top_sellers)
    return t.select(F.lit(L.TOP_RANKING).alias("ranking"), *_RANK_COLS[1:])


def bottom_sellers(mk: Marketplace, p: Params, base: DataFrame | None = None) -> DataFrame:
    """Worst scores first (a NULL score sorts first, as NULL is the smallest
    value in ascending order), then highest late %."""
    sc = _ranked(mk, p, base)
    t = top_k(sc, [F.col("score_prom").asc_nulls_first(), F.col("pct_tardias").desc_nulls_last(),
                   F.col("seller_id").asc()], p.bottom_sellers)
    return (t.select(F.lit(L.BOTTOM_RANKING).alias("ranking"), *_RANK_COLS[1:])
            .orderBy(F.col("score_prom").asc_nulls_first(), F.col("pct_tardias").desc_nulls_last(),
                     F.col("seller_id").asc()))


def seller_scorecard_mart(mk: Marketplace, p: Params, base: DataFrame | None = None) -> DataFrame:
    base = seller_performance(mk, p) if base is None else base
    sc = _rounded_scorecard(base.where(F.col("pedidos") >= p.scorecard_mart_min_orders))
    return (sc.select("seller_id", "seller_state", "pedidos", "revenue", "score_prom",
                      "dias_entrega_prom", "pct_tardias").orderBy(F.col("revenue").desc()))
