"""Reusable DataFrame operators the analysis plans are built from."""

from tianguis.operators.balance import balance
from tianguis.operators.consolidate import Agg, consolidate
from tianguis.operators.kpi import kpi_table
from tianguis.operators.periods import in_window, period_metrics, period_over_period, years_months
from tianguis.operators.quality import duplicate_keys, missing_children, null_profile, orphan_keys, row_counts
from tianguis.operators.ranking import top_k
from tianguis.operators.shares import cumulative_share, distribution, grand_total, share_of_total
from tianguis.operators.stats import exact_median, exact_top_sum, summary_stats, value_bucket

__all__ = [
    "Agg", "balance", "consolidate", "cumulative_share", "distribution", "duplicate_keys",
    "exact_median", "exact_top_sum", "grand_total", "in_window", "kpi_table", "missing_children",
    "null_profile", "orphan_keys", "period_metrics", "period_over_period", "value_bucket",
    "row_counts", "share_of_total", "summary_stats", "top_k", "years_months",
]
