"""Data-quality operators: volumes, duplicate keys, NULL profiles, orphans, missing children."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_counts(tables: dict[str, DataFrame], label: str = "tabla", value: str = "total_filas") -> DataFrame:
    """One row per table: (label, COUNT(*)). Each count is a global aggregate with
    partial counts per task, so only one number per partition crosses the network."""
    parts = [df.agg(F.count(F.lit(1)).alias(value)).select(F.lit(name).alias(label), value)
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(df: DataFrame, key: str, count_alias: str = "cant") -> DataFrame:
    """Keys that occur more than once, with their count (GROUP BY .. HAVING COUNT(*) > 1)."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias(count_alias))
            .where(F.col(count_alias) > 1))


def null_profile(df: DataFrame, checks: dict[str, Column | str], total_alias: str = "total") -> DataFrame:
    """Single pass: row count plus, per alias, the number of rows whose column is NULL.
    On empty input the count is 0 and the NULL counts are NULL (SUM of nothing)."""
    aggs = [F.count(F.lit(1)).alias(total_alias)]
    for alias, c in checks.items():
        col = F.col(c) if isinstance(c, str) else c
        aggs.append(F.sum(F.when(col.isNull(), F.lit(1)).otherwise(F.lit(0))).cast("bigint").alias(alias))
    return df.agg(*aggs)


def orphan_keys(child: DataFrame, parent: DataFrame, key: str, alias: str) -> DataFrame:
    """Number of distinct child keys with no parent row.

    Written as an anti join (a LEFT JOIN .. IS NULL would stay an outer join).
    Both sides are de-duplicated first: the map-side partial aggregate collapses
    repeated keys (a hot key included) before the shuffle, and the anti join then
    reuses that hash partitioning. A NULL child key never matches, but it is not
    counted (COUNT DISTINCT skips NULL)."""
    c = child.select(key).distinct()
    p = parent.select(key).distinct()
    return c.join(p, key, "left_anti").agg(F.count(F.col(key)).alias(alias))


def missing_children(parent: DataFrame, child: DataFrame, key: str, alias: str) -> DataFrame:
    """Number of parent rows with no child row (NOT EXISTS), as an anti join
    against the de-duplicated child keys."""
    c = child.select(key).distinct()
    return parent.select(key).join(c, key, "left_anti").agg(F.count(F.lit(1)).alias(alias))
