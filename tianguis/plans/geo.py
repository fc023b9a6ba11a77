"""Phase 4 — geography and products: revenue by buyer and seller state,
concentration, buyer/seller balance, category and product rankings,
price x volume quadrants, BI marts.

Fact rows are reduced before they meet a dimension: payments per order,
items per seller or per product. A hot seller or product therefore costs one
row per task after the map-side partial aggregate; seller and product joins see
one row per key on each side, and category labels meet one row per category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tianguis.functions import labels as L
from tianguis.functions.numeric import pct, round_dec, round_half_up, safe_div
from tianguis.functions.rules import classify
from tianguis.operators.balance import balance
from tianguis.operators.distinct import count_two_distinct
from tianguis.operators.ranking import top_k
from tianguis.operators.shares import cumulative_share, share_of_total
from tianguis.params import Params
from tianguis.plans.common import in_scope, valid_payments
from tianguis.sources.model import Marketplace


# ---------------------------------------------------------------- buyer side
def paid_by_buyers(mk: Marketplace, p: Params, *order_cols: str) -> DataFrame:
    """Delivered orders with a valid payment and their buyers: order_id, ``order_cols``,
    customer_unique_id, estado, pay_sum, pay_rows. What a report does not read of it is pruned."""
    pay = (valid_payments(mk, p, "payment_value").groupBy("order_id")
           .agg(F.sum("payment_value").alias("pay_sum"), F.count("payment_value").alias("pay_rows")))
    o = in_scope(mk, p, "customer_id", *order_cols).join(pay, "order_id", "inner")
    c = mk.customers.select("customer_id", "customer_unique_id", F.col("customer_state").alias("estado"))
    return o.join(c, "customer_id", "inner")


def _buyer_state_base(mk: Marketplace, p: Params) -> DataFrame:
    """Per buyer state: distinct orders, distinct buyers, payment sum and rows."""
    return (count_two_distinct(paid_by_buyers(mk, p), ["estado"], ("order_id", "pedidos"),
                               ("customer_unique_id", "clientes_unicos"), ["pay_sum", "pay_rows"], p.approximate_distinct)
            .withColumnsRenamed({"pay_sum": "_rev", "pay_rows": "_rows"}))


def state_revenue(mk: Marketplace, p: Params) -> DataFrame:
    g = share_of_total(_buyer_state_base(mk, p), "_rev", "pct_revenue", 1)
    return (g.select("estado", "pedidos", "clientes_unicos", round_half_up("_rev", 2).alias("revenue"),
                     round_half_up(safe_div("_rev", "_rows"), 2).alias("ticket_promedio"), "pct_revenue")
            .orderBy(F.col("revenue").desc()))


def _buyer_state_revenue(mk: Marketplace, p: Params, alias: str) -> DataFrame:
    """(estado, revenue rounded to cents, kept DECIMAL for exact later sums). Built
    without the distinct counts: sums only, so rows collapse map-side before the one exchange by state."""
    sums = paid_by_buyers(mk, p).groupBy("estado").agg(F.sum("pay_sum").alias("_rev"))
    return sums.select("estado", round_dec("_rev", 2).alias(alias))


def pareto_states(mk: Marketplace, p: Params) -> DataFrame:
    """Individual and cumulative % of the (rounded) state revenue. Tied
    revenues share a cumulative value (RANGE frame). One row per state, so the
    unpartitioned window sees a bounded number of rows."""
    g = cumulative_share(_buyer_state_revenue(mk, p, "revenue"), "revenue", "_cum", "_tot")
    return (g.select("estado", F.col("revenue").cast("double").alias("revenue"),
                     round_half_up(pct("revenue", "_tot"), 1).alias("pct_individual"),
                     round_half_up(pct("_cum", "_tot"), 1).alias("pct_acumulado"))
            .orderBy(F.col("revenue").desc()))


def buyer_state_mart(mk: Marketplace, p: Params) -> DataFrame:
    return buyer_states_shown(_buyer_state_base(mk, p))


def buyer_states_shown(g: DataFrame) -> DataFrame:
    return (g.select("estado", "pedidos", F.col("clientes_unicos").alias("clientes"),
                     round_half_up("_rev", 2).alias("revenue"),
                     round_half_up(safe_div("_rev", "_rows"), 2).alias("ticket_promedio"))
            .orderBy(F.col("revenue").desc()))


# --------------------------------------------------------------- seller side
def _delivered_items(mk: Marketplace, p: Params, *cols: str, by: tuple[str, ...] = ()) -> DataFrame:
    keep = list(dict.fromkeys(("order_id",) + cols))
    return mk.items.select(*keep).join(in_scope(mk, p, *by), "order_id", "inner")


def _seller_state_base(mk: Marketplace, p: Params) -> DataFrame:
    per_seller = (_delivered_items(mk, p, "seller_id", "price").groupBy("seller_id")
                  .agg(F.sum("price").alias("sp"), F.count("price").alias("np")))
    s = mk.sellers.select("seller_id", "seller_state")
    return (per_seller.join(s, "seller_id", "inner")
            .groupBy(F.col("seller_state").alias("estado_vendedor"))
            .agg(F.countDistinct("seller_id").alias("sellers"),
                 F.sum("sp").alias("_rev"), F.sum("np").alias("_n")))


def seller_state_revenue(mk: Marketplace, p: Params) -> DataFrame:
    g = share_of_total(_seller_state_base(mk, p), "_rev", "pct_revenue", 1)
    return (g.select("estado_vendedor", "sellers", round_half_up("_rev", 2).alias("revenue_generado"),
                     "pct_revenue", round_half_up(safe_div("_rev", "_n"), 2).alias("precio_prom_item"))
            .orderBy(F.col("revenue_generado").desc()))


def state_balance(mk: Marketplace, p: Params) -> DataFrame:
    """Purchases minus sales per buyer state (``balance_join`` "left", the
    default: states that only sell are not listed; "full" lists them too)."""
    buy = _buyer_state_revenue(mk, p, "revenue_compras")
    sell = _seller_state_base(mk, p).select(F.col("estado_vendedor").alias("estado"),
                                            round_dec("_rev", 2).alias("revenue_ventas"))
    b = balance(buy, sell, "estado", "revenue_compras", "revenue_ventas", "balance", how=p.balance_join)
    return (b.select("estado", F.col("revenue_compras").cast("double").alias("revenue_compras"),
                     F.col("revenue_ventas").cast("double").alias("revenue_ventas"), "balance")
            .orderBy(F.col("balance").desc()))


# ---------------------------------------------------------------- categories
#: Additive measures of a product or category.
CATEGORY_SUMS = ("units", "sp", "np", "sf", "nf")


def _per_product(mk: Marketplace, p: Params, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums per product sold in delivered orders (and further columns of the orders)."""
    return (_delivered_items(mk, p, "product_id", "order_item_id", "price", "freight_value", by=by)
            .groupBy("product_id", *by)
            .agg(F.count("order_item_id").alias("units"),
                 F.sum("price").alias("sp"), F.count("price").alias("np"),
                 F.sum("freight_value").alias("sf"), F.count("freight_value").alias("nf")))


def _labelled(df: DataFrame, mk: Marketplace) -> DataFrame:
    """``df`` with the label of its category: the translated name, or the fixed
    'no category' label when the category is NULL or has no translation."""
    tr = mk.translation.select("product_category_name", "product_category_name_english")
    label = F.coalesce(F.col("product_category_name_english"), F.lit(L.NO_CATEGORY))
    return df.join(tr, "product_category_name", "left").withColumn("categoria", label)


def category_sums(mk: Marketplace, p: Params, by: tuple[str, ...] = ()) -> DataFrame:
    """Products summed per category name (and further columns of the orders)."""
    prod = mk.products.select("product_id", "product_category_name")
    return (_per_product(mk, p, by).join(prod, "product_id", "inner").groupBy("product_category_name", *by)
            .agg(*[F.sum(c).alias(c) for c in CATEGORY_SUMS]))


def by_label(names: DataFrame, mk: Marketplace) -> DataFrame:
    """Sums per category label, from sums per category name: the labels meet one row per name."""
    return _labelled(names, mk).groupBy("categoria").agg(*[F.sum(c).alias(c) for c in CATEGORY_SUMS])


def _category_base(mk: Marketplace, p: Params) -> DataFrame:
    return by_label(category_sums(mk, p), mk)


def top_categories_by_revenue(mk: Marketplace, p: Params) -> DataFrame:
    """Shares are taken over all categories before the top-k cut."""
    g = share_of_total(_category_base(mk, p), "sp", "pct_revenue", 1)
    g = g.select("categoria", F.col("units").alias("unidades_vendidas"),
                 round_half_up("sp", 2).alias("revenue"), "pct_revenue",
                 round_half_up(safe_div("sp", "np"), 2).alias("precio_promedio"))
    return top_k(g, [F.col("revenue").desc_nulls_last(), F.col("categoria").asc()], p.top_categories_by_revenue)


def top_categories_by_units(mk: Marketplace, p: Params) -> DataFrame:
    g = _category_base(mk, p).select(
        "categoria", F.col("units").alias("unidades_vendidas"),
        round_half_up(safe_div("sp", "np"), 2).alias("precio_promedio"),
        round_half_up("sp", 2).alias("revenue"))
    return top_k(g, [F.col("unidades_vendidas").desc(), F.col("categoria").asc()], p.top_categories_by_units)


def category_quadrants(mk: Marketplace, p: Params) -> DataFrame:
    """Categories above the unit floor in four price x volume quadrants; the
    rules read the rounded mean price, as the report shows it."""
    g = (_category_base(mk, p).where(F.col("units") > p.quadrant_min_units)
         .select("categoria", F.col("units").alias("unidades"),
                 round_half_up(safe_div("sp", "np"), 2).alias("precio_prom"),
                 round_half_up("sp", 2).alias("revenue")))
    hi_price = F.col("precio_prom") >= F.lit(p.quadrant_price)
    lo_price = F.col("precio_prom") < F.lit(p.quadrant_price)
    hi_units = F.col("unidades") >= F.lit(p.quadrant_units)
    lo_units = F.col("unidades") < F.lit(p.quadrant_units)
    g = g.withColumn("segmento", classify([
        (L.QUADRANT_STAR, hi_price & hi_units),
        (L.QUADRANT_PREMIUM, hi_price & lo_units),
        (L.QUADRANT_COMMODITY, lo_price & hi_units),
    ], L.QUADRANT_LONG_TAIL))
    return top_k(g, [F.col("revenue").desc_nulls_last(), F.col("categoria").asc()], p.top_categories_quadrants)


def best_per_kind(sold: DataFrame, mk: Marketplace, k: int) -> DataFrame:
    """Of the products of one kind (the same category names, each as often) the k of largest
    revenue, one row per category name. Labels repeat the sums of one kind's products alike, so the k
    largest labelled products are among these. Each task keeps k products per kind before any exchange
    by kind, however many products a category has."""
    names = mk.products.groupBy("product_id").agg(F.collect_list(F.struct("product_category_name")).alias("_names"))
    kind = F.to_json(F.sort_array("_names"))  # a plain string also where names are collated
    order = W.partitionBy("_kind").orderBy(F.col("sp").desc_nulls_last(), F.col("product_id").asc())
    best = (sold.join(names, "product_id", "inner").withColumn("_kind", kind)
            .withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k))
    return best.select("product_id", "units", "sp", "np", F.inline("_names"))


def top_products(mk: Marketplace, p: Params) -> DataFrame:
    """Only candidates meet the category labels: k products per kind. Ties by product, then label."""
    k = p.top_products
    g = (_labelled(best_per_kind(_per_product(mk, p), mk, k), mk).groupBy("product_id", "categoria")
         .agg(F.sum("units").alias("unidades_vendidas"), F.sum("sp").alias("sp"), F.sum("np").alias("np")))
    t = top_k(g, [F.col("sp").desc_nulls_last(), F.col("product_id").asc(), F.col("categoria").asc()], k)
    return t.select("product_id", "categoria", "unidades_vendidas", round_half_up("sp", 2).alias("revenue"),
                    round_half_up(safe_div("sp", "np"), 2).alias("precio_promedio"))


def category_mart(mk: Marketplace, p: Params) -> DataFrame:
    return categories_shown(_category_base(mk, p))


def categories_shown(base: DataFrame) -> DataFrame:
    return (base.select("categoria", F.col("units").alias("unidades"),
                    round_half_up("sp", 2).alias("revenue"),
                    round_half_up(safe_div("sp", "np"), 2).alias("precio_promedio"),
                    round_half_up(safe_div("sf", "nf"), 2).alias("flete_promedio"))
            .orderBy(F.col("revenue").desc()))
