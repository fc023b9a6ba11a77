"""Phase 2 — core business metrics over delivered orders: revenue, volume,
ticket statistics, item price and freight, basket size, payment mix, KPIs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tianguis.functions import labels as L
from tianguis.functions.numeric import mean, pct, round_half_up, safe_div
from tianguis.operators.consolidate import Agg, consolidate
from tianguis.operators.distinct import count_two_distinct
from tianguis.operators.kpi import kpi_table
from tianguis.operators.shares import share_of_total
from tianguis.operators.stats import median, summary_stats
from tianguis.params import Params
from tianguis.plans.common import flag, in_scope, valid_payments
from tianguis.sources.model import Marketplace

#: Type of per-order ratios.
RATIO = "decimal(38,10)"


def paid_per_order(mk: Marketplace, p: Params, exclude_type: bool = False) -> DataFrame:
    """One row per delivered order: total paid (exact DECIMAL sum of its payments)."""
    pays = valid_payments(mk, p, "payment_value") if exclude_type else mk.payments.select("order_id", "payment_value")
    return consolidate(pays, in_scope(mk, p), "order_id", {"order_total": Agg("sum", "payment_value")})


def items_per_order(mk: Marketplace, p: Params) -> DataFrame:
    """One row per delivered order with items: item revenue, freight, item count
    (= MAX(order_item_id), item numbers are sequential)."""
    return consolidate(mk.items, in_scope(mk, p), "order_id", {
        "items_revenue": Agg("sum", "price"),
        "items_freight": Agg("sum", "freight_value"),
        "cantidad_items": Agg("max", "order_item_id"),
    })


def revenue_total(mk: Marketplace, p: Params) -> DataFrame:
    t = paid_per_order(mk, p)
    return t.agg(round_half_up(F.sum("order_total"), 2).alias("revenue_total"),
                 F.count(F.lit(1)).alias("total_pedidos"),
                 round_half_up(mean("order_total"), 2).alias("ticket_promedio"))


def order_volume(mk: Marketplace, p: Params) -> DataFrame:
    j = in_scope(mk, p, "customer_id").join(mk.customers.select("customer_id", "customer_unique_id"),
                                            "customer_id", "inner")
    a = count_two_distinct(j, [], ("order_id", "total_pedidos_entregados"),
                           ("customer_unique_id", "clientes_unicos"), [], p.approximate_distinct)
    return a.select("*", round_half_up(safe_div("total_pedidos_entregados", "clientes_unicos"), 2)
                    .alias("pedidos_por_cliente"))


def ticket_stats(mk: Marketplace, p: Params) -> DataFrame:
    s = summary_stats(paid_per_order(mk, p), "order_total", p.quantile_k)
    return s.select(round_half_up("mean", 2).alias("ticket_promedio"),
                    round_half_up("min", 2).alias("ticket_minimo"),
                    round_half_up("max", 2).alias("ticket_maximo"),
                    round_half_up("median", 2).alias("ticket_mediana"))


def ticket_median_by_rank(mk: Marketplace, p: Params) -> DataFrame:
    """Median as the mean of the middle value(s) by rank, unrounded. The exact
    value has at most three decimals; it is fixed to three decimals so the DOUBLE
    carries no representation noise."""
    m = median(paid_per_order(mk, p), "order_total", p.quantile_k)
    return m.select(round_half_up("median", 3).alias("ticket_mediana"))


def price_and_freight(mk: Marketplace, p: Params) -> DataFrame:
    """Global means need no row per order: the narrow item rows of delivered
    orders are aggregated as they leave the join."""
    sold = mk.items.select("order_id", "price", "freight_value").join(in_scope(mk, p), "order_id", "inner")
    a = sold.agg(F.sum("price").alias("sp"), F.count("price").alias("np"),
                 F.sum("freight_value").alias("sf"), F.count("freight_value").alias("nf"),
                 F.min("price").alias("minp"), F.max("price").alias("maxp"))
    mp = safe_div("sp", "np")
    mf = safe_div("sf", "nf")
    return a.select(round_half_up(mp, 2).alias("precio_promedio_item"),
                    round_half_up(mf, 2).alias("flete_promedio"),
                    round_half_up(safe_div(mf, mp) * F.lit(100.0), 1).alias("flete_pct_del_precio"),
                    round_half_up("minp", 2).alias("precio_minimo"),
                    round_half_up("maxp", 2).alias("precio_maximo"))


def items_per_order_histogram(mk: Marketplace, p: Params) -> DataFrame:
    g = (items_per_order(mk, p)
         .groupBy(F.col("cantidad_items").cast("bigint").alias("cantidad_items"))
         .agg(F.count(F.lit(1)).alias("pedidos")))
    return share_of_total(g, "pedidos", "porcentaje", 2).orderBy("cantidad_items")


def items_summary(mk: Marketplace, p: Params) -> DataFrame:
    a = items_per_order(mk, p).agg(
        round_half_up(mean("cantidad_items"), 2).alias("items_promedio_por_pedido"),
        F.sum(flag(F.col("cantidad_items") == 1)).cast("bigint").alias("pedidos_un_item"),
        F.count(F.lit(1)).alias("_n"))
    return a.select("items_promedio_por_pedido", "pedidos_un_item",
                    round_half_up(pct("pedidos_un_item", "_n"), 1).alias("pct_pedidos_un_item"))


def payment_mix(mk: Marketplace, p: Params) -> DataFrame:
    """Per payment type over delivered orders: distinct orders, revenue,
    their shares, mean instalments. Payments are consolidated per
    (order, type) before the join, then summed per type."""
    per = consolidate(valid_payments(mk, p, "payment_type", "payment_value", "payment_installments"),
                      in_scope(mk, p), "order_id", {
                          "rev": Agg("sum", "payment_value"),
                          "inst": Agg("sum", "payment_installments"),
                          "ninst": Agg("count", "payment_installments"),
                      }, by=["payment_type"])
    g = per.groupBy(F.col("payment_type").alias("medio_de_pago")).agg(
        F.count(F.lit(1)).alias("pedidos"), F.sum("rev").alias("_rev"),
        F.sum("inst").alias("_inst"), F.sum("ninst").alias("_ninst"))
    g = share_of_total(g, "pedidos", "pct_pedidos", 1)
    g = share_of_total(g, "_rev", "pct_revenue", 1)
    return (g.select("medio_de_pago", "pedidos", "pct_pedidos",
                     round_half_up("_rev", 2).alias("revenue"), "pct_revenue",
                     round_half_up(safe_div("_inst", "_ninst"), 1).alias("cuotas_promedio"))
            .orderBy(F.col("revenue").desc()))


def kpi_summary(mk: Marketplace, p: Params) -> DataFrame:
    """Seven KPIs from two per-order consolidations, each aggregated once. The
    per-order ratios are fixed to DECIMAL before they are added, so the sums do not
    depend on the order of the rows."""
    pay = paid_per_order(mk, p, exclude_type=True).agg(
        round_half_up(F.sum("order_total"), 2).alias("rev"),
        F.count(F.lit(1)).alias("n"),
        round_half_up(mean("order_total"), 2).alias("ticket"))
    it = items_per_order(mk, p).select(
        safe_div("items_revenue", "cantidad_items").cast(RATIO).alias("unit_price"),
        "items_freight",
        safe_div("items_freight", "items_revenue").cast(RATIO).alias("freight_ratio"),
        "cantidad_items",
    ).agg(round_half_up(mean("unit_price"), 2).alias("price"),
          round_half_up(mean("items_freight"), 2).alias("freight"),
          round_half_up(mean("freight_ratio") * F.lit(100.0), 1).alias("freight_pct"),
          round_half_up(mean("cantidad_items"), 2).alias("items"))
    k = L.KPI_LABELS
    return reduce(DataFrame.unionByName, [
        kpi_table(pay, [(k[0], "rev"), (k[1], "n"), (k[2], "ticket")], "kpi", "valor"),
        kpi_table(it, [(k[3], "price"), (k[4], "freight"), (k[5], "freight_pct"), (k[6], "items")],
                  "kpi", "valor"),
    ])
