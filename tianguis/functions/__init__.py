"""Column expressions shared by all plans (JVM-side, whole-stage-codegen friendly)."""

from tianguis.functions.dates import (
    days_between,
    month_label,
    ts_literal,
    week_monday_first,
    weekday_name,
    weekday_number,
    year_month,
)
from tianguis.functions.numeric import mean, pct, round_dec, round_half_up, safe_div
from tianguis.functions.rules import Band, bucketize, classify

__all__ = [
    "Band", "bucketize", "classify", "days_between", "mean", "month_label", "pct",
    "round_dec", "round_half_up", "safe_div", "ts_literal", "week_monday_first",
    "weekday_name", "weekday_number", "year_month",
]
