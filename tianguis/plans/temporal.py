"""Phase 3 — time analysis: monthly trend, month-on-month growth, year over
year, weekday and hour seasonality, peak weeks, monthly BI mart.

Payment-based plans pre-aggregate payments per order (sum and row count)
before joining the in-scope orders; month/year/week figures are then sums
of those partials, which equals aggregating the joined payment rows
(the mean ticket stays a mean per payment row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tianguis.functions.dates import month_label, week_monday_first, weekday_name, weekday_number, year_month
from tianguis.functions.numeric import round_dec, round_half_up, safe_div
from tianguis.functions.rules import bucketize
from tianguis.operators.periods import in_window, period_metrics, period_over_period, years_months
from tianguis.operators.distinct import count_two_distinct
from tianguis.operators.reduction import keep_matching
from tianguis.operators.shares import distribution, share_of_total
from tianguis.params import Params
from tianguis.plans.common import PTS, in_scope, valid_payments
from tianguis.sources.model import Marketplace


def paid_orders(mk: Marketplace, p: Params, window: Column, *order_cols: str, narrow: bool = False) -> DataFrame:
    """In-scope orders inside ``window`` joined with their valid payments,
    consolidated per order: (order_id, order_cols..., pay_sum, pay_rows). For a ``narrow``
    window (some months of many years) payments are first reduced to those of its orders, so that
    the others are never shuffled; it costs a second scan of the orders."""
    o = in_scope(mk, p, PTS, *order_cols).where(window)
    pays = valid_payments(mk, p, "payment_value")
    if narrow and p.slice_filter_bits:
        pays = keep_matching(pays, o.select("order_id"), "order_id", p.slice_filter_bits)
    pay = pays.groupBy("order_id").agg(F.sum("payment_value").alias("pay_sum"), F.count("payment_value").alias("pay_rows"))
    return o.join(pay, "order_id", "inner")


def _revenue_aggs() -> dict[str, Column]:
    return {
        "pedidos": F.countDistinct("order_id"),
        "_rev": F.sum("pay_sum"),
        "_rows": F.sum("pay_rows"),
    }


def monthly(mk: Marketplace, p: Params) -> DataFrame:
    base = paid_orders(mk, p, in_window(PTS, p.analysis_start))
    g = period_metrics(base, {"mes": year_month(PTS)}, _revenue_aggs())
    return g.select("mes", "pedidos", round_half_up("_rev", 2).alias("revenue"),
                    round_half_up(safe_div("_rev", "_rows"), 2).alias("ticket_promedio")).orderBy("mes")


def month_over_month(mk: Marketplace, p: Params) -> DataFrame:
    """Growth on the rounded monthly revenue, as the monthly table holds it."""
    base = paid_orders(mk, p, in_window(PTS, p.analysis_start))
    g = (period_metrics(base, {"mes": year_month(PTS)}, {"_rev": F.sum("pay_sum")})
         .select("mes", round_dec("_rev", 2).alias("revenue")))
    g = period_over_period(g, "mes", "revenue", "revenue_mes_anterior", "crecimiento_pct", 1)
    return g.select("mes", F.col("revenue").cast("double").alias("revenue"),
                    F.col("revenue_mes_anterior").cast("double").alias("revenue_mes_anterior"),
                    "crecimiento_pct").orderBy("mes")


def year_over_year(mk: Marketplace, p: Params) -> DataFrame:
    base = paid_orders(mk, p, years_months(PTS, p.compare_years, p.compare_months), narrow=True)
    g = period_metrics(base, {"anio": F.year(PTS).cast("bigint")}, _revenue_aggs())
    return g.select("anio", "pedidos", round_half_up("_rev", 2).alias("revenue"),
                    round_half_up(safe_div("_rev", "_rows"), 2).alias("ticket_promedio")).orderBy("anio")


def _scoped_since_start(mk: Marketplace, p: Params) -> DataFrame:
    return in_scope(mk, p, PTS).where(in_window(PTS, p.analysis_start))


def weekday_profile(mk: Marketplace, p: Params) -> DataFrame:
    g = period_metrics(_scoped_since_start(mk, p),
                       {"dia_semana": weekday_name(PTS), "dia_num": weekday_number(PTS)},
                       {"pedidos": F.countDistinct("order_id")})
    return share_of_total(g, "pedidos", "pct_pedidos", 1).orderBy("dia_num")


def hour_profile(mk: Marketplace, p: Params) -> DataFrame:
    g = period_metrics(_scoped_since_start(mk, p), {"hora": F.hour(PTS).cast("bigint")},
                       {"pedidos": F.countDistinct("order_id")})
    g = share_of_total(g, "pedidos", "pct_pedidos", 1)
    return g.withColumn("franja_horaria", bucketize("hora", p.hour_parts, p.hour_part_other)).orderBy("hora")


def daypart_profile(mk: Marketplace, p: Params) -> DataFrame:
    part = bucketize(F.hour(PTS), p.numbered_hour_parts, p.numbered_hour_part_other)
    return (distribution(_scoped_since_start(mk, p), [part.alias("franja")],
                         {"pedidos": F.countDistinct("order_id")}, [("pedidos", "pct_pedidos", 1)])
            .orderBy("franja"))


def peak_weeks(mk: Marketplace, p: Params) -> DataFrame:
    """Weeks (Monday start, 0..53) inside the peak window; ``inicio_semana`` is
    the first purchase date observed in the week, not the calendar Monday."""
    base = paid_orders(mk, p, in_window(PTS, p.peak_start, p.peak_end), narrow=True)
    g = period_metrics(base, {"semana_del_anio": week_monday_first(PTS)}, {
        "inicio_semana": F.min(F.to_date(PTS)),
        "pedidos": F.countDistinct("order_id"),
        "_rev": F.sum("pay_sum"),
    })
    return g.select("semana_del_anio", "inicio_semana", "pedidos",
                    round_half_up("_rev", 2).alias("revenue")).orderBy("semana_del_anio")


def monthly_mart(mk: Marketplace, p: Params) -> DataFrame:
    rows, keys = month_rows(mk, p)
    return months_shown(count_two_distinct(rows, keys, ("order_id", "pedidos"), ("customer_id", "clientes"),
                                           ["pay_sum", "pay_rows"], p.approximate_distinct))


def month_rows(mk: Marketplace, p: Params) -> tuple[DataFrame, list[str]]:
    """Paid orders since the start of the analysis with the names of their month, and those names' columns."""
    base = paid_orders(mk, p, in_window(PTS, p.analysis_start), "customer_id")
    periods = {
        "mes": year_month(PTS),
        "anio": F.year(PTS).cast("bigint"),
        "nro_mes": F.month(PTS).cast("bigint"),
        "mes_label": month_label(PTS),
    }
    rows = base.select("order_id", "customer_id", "pay_sum", "pay_rows", *[c.alias(a) for a, c in periods.items()])
    return rows, list(periods)


def months_shown(g: DataFrame) -> DataFrame:
    return g.select("mes", "anio", "nro_mes", "mes_label", "pedidos",
                    round_half_up("pay_sum", 2).alias("revenue"),
                    round_half_up(safe_div("pay_sum", "pay_rows"), 2).alias("ticket_promedio"),
                    "clientes").orderBy("mes")
