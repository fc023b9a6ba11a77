"""Shares of a total and cumulative shares, over already-aggregated rows.

The total is ``SUM(measure) OVER ()`` on the grouped result. Every share in
the analyses is taken over a bounded key set (order statuses, payment types,
bands, hours, weekdays, months, states, categories, seller segments), so the
window's single partition holds at most a few hundred rows however large the
fact tables grow; the heavy work (scans, joins, partial and final aggregates)
stays partitioned below it. A scalar subquery would also work, but it
re-executes the whole input (column pruning makes its plan differ from the
main one, so no exchange is reused).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tianguis.functions.numeric import pct, round_half_up

def grand_total(measure: str) -> Column:
    """SUM(measure) over all rows of the (aggregated) DataFrame it is used on."""
    return F.sum(F.col(measure)).over(Window.partitionBy())


def share_of_total(df: DataFrame, measure: str, alias: str, digits: int) -> DataFrame:
    """Add ``alias`` = round(measure * 100 / SUM(measure) OVER (), digits).

    ``df`` must be a grouped result over a bounded key set; call it *before*
    any top-k cut, so the denominator covers every group."""
    return df.withColumn(alias, round_half_up(pct(F.col(measure), grand_total(measure)), digits))


def distribution(df: DataFrame, by: list[str | Column], measures: dict[str, Column],
                 shares: list[tuple[str, str, int]]) -> DataFrame:
    """GROUP BY ``by`` with ``measures``, then one share column per
    ``(measure, share_alias, digits)``. Shares use the exact (unrounded) measure."""
    out = df.groupBy(*by).agg(*[c.alias(a) for a, c in measures.items()])
    for measure, alias, digits in shares:
        out = share_of_total(out, measure, alias, digits)
    return out


def cumulative_share(df: DataFrame, measure: str, running_alias: str, total_alias: str) -> DataFrame:
    """Running SUM(measure) ordered by measure DESC with the default RANGE frame
    (tied values share one running total), plus the grand total.

    Like the total, the running sum has no PARTITION BY: it is meant for
    aggregated rows over a bounded key set (states, months)."""
    w = Window.orderBy(F.col(measure).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (df.withColumn(running_alias, F.sum(F.col(measure)).over(w))
              .withColumn(total_alias, grand_total(measure)))
