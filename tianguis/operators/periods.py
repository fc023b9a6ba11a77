"""Period metrics and period-over-period change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tianguis.functions.dates import ts_literal
from tianguis.functions.numeric import round_half_up, safe_div


def in_window(ts: str, start: str | None = None, end: str | None = None) -> Column:
    """Half-open [start, end) on a raw timestamp column with typed literals, so
    Parquet row groups can be skipped by min/max statistics."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(ts) >= ts_literal(start))
    if end is not None:
        cond = cond & (F.col(ts) < ts_literal(end))
    return cond


def years_months(ts: str, years: tuple[int, ...], months: tuple[int, int]) -> Column:
    """YEAR(ts) IN years AND MONTH(ts) BETWEEN months, plus the equivalent
    timestamp range on the raw column (redundant for the result, but it is the
    form the scan can push down; YEAR()/MONTH() predicates cannot)."""
    lo, hi = min(years), max(years)
    return (in_window(ts, f"{lo}-01-01", f"{hi + 1}-01-01")
            & F.year(F.col(ts)).isin(*years)
            & F.month(F.col(ts)).between(months[0], months[1]))


def period_metrics(df: DataFrame, periods: dict[str, Column], aggs: dict[str, Column]) -> DataFrame:
    """GROUP BY the period expressions (computed before the aggregate)."""
    return df.groupBy(*[c.alias(a) for a, c in periods.items()]).agg(*[c.alias(a) for a, c in aggs.items()])


def period_over_period(df: DataFrame, period: str, measure: str, prev_alias: str,
                       change_alias: str, digits: int) -> DataFrame:
    """Previous period's measure (LAG 1 in period order) and the % change
    round((m - prev) / prev * 100, digits); NULL for the first period or a zero
    previous value.

    The window has no PARTITION BY: use it on aggregated rows only (one per
    period), never on fact rows."""
    w = Window.orderBy(F.col(period))
    prev = F.lag(F.col(measure), 1).over(w)
    return (df.withColumn(prev_alias, prev)
              .withColumn(change_alias,
                          round_half_up(safe_div(F.col(measure) - F.col(prev_alias), F.col(prev_alias))
                                        * F.lit(100.0), digits)))
