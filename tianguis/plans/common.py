"""Scopes and shared building blocks of the analysis plans.

Column names follow the marketplace schema; every plan projects the few
columns it needs right after the scan, so Parquet reads only those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tianguis.functions.dates import days_between
from tianguis.params import Params
from tianguis.sources.model import Marketplace

PTS = "order_purchase_timestamp"
DELIVERED_AT = "order_delivered_customer_date"
ESTIMATED_AT = "order_estimated_delivery_date"


def in_scope(mk: Marketplace, p: Params, *cols: str) -> DataFrame:
    """Orders with the scope status (default 'delivered'), projected to ``cols``."""
    keep = list(dict.fromkeys(("order_id",) + cols))
    return mk.orders.where(F.col("order_status") == p.scope_status).select(*keep)


def valid_payments(mk: Marketplace, p: Params, *cols: str) -> DataFrame:
    """Payments whose type is not the excluded one ('!=' also drops a NULL type)."""
    keep = list(dict.fromkeys(("order_id",) + cols))
    return mk.payments.where(F.col("payment_type") != p.excluded_payment_type).select(*keep)


def is_late() -> Column:
    """Delivered after the estimate (NULL when either date is NULL)."""
    return F.col(DELIVERED_AT) > F.col(ESTIMATED_AT)


def delivery_days() -> Column:
    return days_between(DELIVERED_AT, PTS)


def flag(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END) building block (NULL counts as 0)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))
