"""Deterministic top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """ORDER BY ``order`` LIMIT k. The caller appends a unique tiebreak and
    spells NULL ordering, so the chosen rows do not depend on partitioning.
    Spark plans this as TakeOrderedAndProject: each task keeps its k best rows
    and only k rows per task reach the final merge."""
    return df.orderBy(*order).limit(k)
