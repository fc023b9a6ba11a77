"""Phase 1 — data quality: volumes, duplicates, NULLs, referential integrity,
status and payment distributions, missing children, late deliveries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tianguis.functions import labels as L
from tianguis.functions.numeric import mean, pct, round_half_up
from tianguis.functions.rules import bucketize
from tianguis.operators.kpi import kpi_table
from tianguis.operators.quality import duplicate_keys, missing_children, null_profile, orphan_keys, row_counts
from tianguis.operators.shares import distribution, share_of_total
from tianguis.params import Params
from tianguis.plans.common import DELIVERED_AT, ESTIMATED_AT, flag, is_late
from tianguis.sources.model import Marketplace


def row_count_report(mk: Marketplace, p: Params) -> DataFrame:
    t = mk.tables()
    return row_counts({name: t[name] for name in L.ROW_COUNT_TABLES})


def duplicate_orders(mk: Marketplace, p: Params) -> DataFrame:
    return duplicate_keys(mk.orders, "order_id", "cant")


def duplicate_customers(mk: Marketplace, p: Params) -> DataFrame:
    return duplicate_keys(mk.customers, "customer_id", "cant")


def unique_customers(mk: Marketplace, p: Params) -> DataFrame:
    return mk.customers.agg(F.count(F.lit(1)).alias("total_registros"),
                            F.countDistinct("customer_unique_id").alias("clientes_unicos"))


def order_nulls(mk: Marketplace, p: Params) -> DataFrame:
    return null_profile(mk.orders, {
        "nulos_aprobacion": "order_approved_at",
        "nulos_fecha_carrier": "order_delivered_carrier_date",
        "nulos_fecha_entrega": DELIVERED_AT,
    })


def product_nulls(mk: Marketplace, p: Params) -> DataFrame:
    return null_profile(mk.products, {"sin_categoria": "product_category_name",
                                      "sin_peso": "product_weight_g"})


def review_nulls(mk: Marketplace, p: Params) -> DataFrame:
    return null_profile(mk.reviews, {"sin_titulo": "review_comment_title",
                                     "sin_mensaje": "review_comment_message"})


def orphan_items(mk: Marketplace, p: Params) -> DataFrame:
    return orphan_keys(mk.items, mk.orders, "order_id", "items_sin_orden")


def orphan_payments(mk: Marketplace, p: Params) -> DataFrame:
    return orphan_keys(mk.payments, mk.orders, "order_id", "pagos_sin_orden")


def orphan_reviews(mk: Marketplace, p: Params) -> DataFrame:
    return orphan_keys(mk.reviews, mk.orders, "order_id", "reviews_sin_orden")


def status_distribution(mk: Marketplace, p: Params) -> DataFrame:
    return (distribution(mk.orders, ["order_status"], {"cantidad": F.count(F.lit(1))},
                         [("cantidad", "porcentaje", 2)])
            .orderBy(F.col("cantidad").desc()))


def payment_distribution(mk: Marketplace, p: Params) -> DataFrame:
    """Distinct orders per payment type; the % denominator is the sum of the
    per-type distinct counts (an order paid two ways counts in both)."""
    g = mk.payments.groupBy("payment_type").agg(
        F.countDistinct("order_id").alias("pedidos"),
        round_half_up(mean("payment_value"), 2).alias("ticket_promedio"))
    return (share_of_total(g, "pedidos", "porcentaje", 2)
            .select("payment_type", "pedidos", "porcentaje", "ticket_promedio")
            .orderBy(F.col("pedidos").desc()))


def orders_without_payment(mk: Marketplace, p: Params) -> DataFrame:
    return missing_children(mk.orders, mk.payments, "order_id", "pedidos_sin_pago")


def orders_without_review(mk: Marketplace, p: Params) -> DataFrame:
    return missing_children(mk.orders, mk.reviews, "order_id", "pedidos_sin_review")


def orders_without_items(mk: Marketplace, p: Params) -> DataFrame:
    return missing_children(mk.orders, mk.items, "order_id", "pedidos_sin_items")


def late_delivery_summary(mk: Marketplace, p: Params) -> DataFrame:
    """Delivered orders with both dates: count, late count and %, mean signed
    day deviation from the estimate (early deliveries pull it down)."""
    o = mk.orders.where((F.col("order_status") == p.scope_status)
                        & F.col(DELIVERED_AT).isNotNull() & F.col(ESTIMATED_AT).isNotNull())
    dev = F.datediff(F.col(DELIVERED_AT), F.col(ESTIMATED_AT))
    agg = o.agg(F.count(F.lit(1)).alias("total_entregados"),
                F.sum(flag(is_late())).cast("bigint").alias("entregas_tardias"),
                F.sum(dev).alias("_dev_sum"), F.count(dev).alias("_dev_n"))
    return agg.select(
        "total_entregados", "entregas_tardias",
        round_half_up(pct("entregas_tardias", "total_entregados"), 2).alias("pct_tardias"),
        round_half_up(F.col("_dev_sum").cast("double") / F.nullif(F.col("_dev_n").cast("double"), F.lit(0.0)), 1)
        .alias("dias_desvio_promedio"))


def late_delay_buckets(mk: Marketplace, p: Params) -> DataFrame:
    """Late orders per delay band; a same-day late delivery (0 days) falls in no
    band and forms the NULL row, which sorts first (smallest delay)."""
    o = mk.orders.where((F.col("order_status") == p.scope_status) & is_late())
    delay = F.datediff(F.col(DELIVERED_AT), F.col(ESTIMATED_AT))
    g = (o.select(bucketize(delay, p.late_delay_bands).alias("rango_retraso"), delay.alias("_d"))
         .groupBy("rango_retraso")
         .agg(F.count(F.lit(1)).alias("cantidad"), F.min("_d").alias("_min_d")))
    return g.orderBy(F.col("_min_d").asc_nulls_first()).select("rango_retraso", "cantidad")


def quality_summary(mk: Marketplace, p: Params) -> DataFrame:
    """Seven stacked metrics with fixed remarks. The four order counts come
    from one scan of orders (filtered COUNTs, 0 on empty input); the two
    missing-children counts are anti joins."""
    status = F.col("order_status")
    o = mk.orders.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(status == p.scope_status, F.lit(1))).alias("delivered"),
        F.count(F.when(status == p.canceled_status, F.lit(1))).alias("canceled"),
        F.count(F.when((status == p.scope_status) & is_late(), F.lit(1))).alias("late"),
    )
    notes = dict(L.QUALITY_SUMMARY)
    labels = [lbl for lbl, _ in L.QUALITY_SUMMARY]
    parts = [
        kpi_table(o, [(labels[0], "total", notes[labels[0]]),
                      (labels[1], "delivered", notes[labels[1]]),
                      (labels[2], "canceled", notes[labels[2]]),
                      (labels[6], "late", notes[labels[6]])],
                  "metrica", "valor", "bigint", note="observacion"),
        kpi_table(missing_children(mk.orders, mk.payments, "order_id", "n"),
                  [(labels[3], "n", notes[labels[3]])], "metrica", "valor", "bigint", note="observacion"),
        kpi_table(missing_children(mk.orders, mk.reviews, "order_id", "n"),
                  [(labels[4], "n", notes[labels[4]])], "metrica", "valor", "bigint", note="observacion"),
        kpi_table(mk.products.where(F.col("product_category_name").isNull()).agg(F.count(F.lit(1)).alias("n")),
                  [(labels[5], "n", notes[labels[5]])], "metrica", "valor", "bigint", note="observacion"),
    ]
    return reduce(DataFrame.unionByName, parts)
