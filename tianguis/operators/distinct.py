"""Two exact distinct counts and sums in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_two_distinct(df: DataFrame, groups: list[str], first: tuple[str, str], second: tuple[str, str],
                       sums: list[str], approximate: bool = False) -> DataFrame:
    """Per group: COUNT(DISTINCT first), COUNT(DISTINCT second) and SUM of each
    of ``sums`` (each pair is (column, output name)).

    Two DISTINCT counts in one aggregate send every row once per count and once
    more for the sums. Here rows are grouped by (group, first) with the few values of second that go
    with it, then by (group, second): each level holds one row per key, and a row that
    counts for ``first`` is marked on its first value only. ``approximate`` takes
    sketches instead, in one level."""
    (a, a_out), (b, b_out) = first, second
    if approximate:
        return df.groupBy(*groups).agg(F.approx_count_distinct(a).alias(a_out), F.approx_count_distinct(b).alias(b_out),
                                       *[F.sum(c).alias(c) for c in sums])
    per_first = df.groupBy(*groups, a).agg(F.collect_set(b).alias("_set"), *[F.sum(c).alias(c) for c in sums])
    flat = per_first.select(*groups, a, *sums, F.posexplode_outer("_set").alias("_at", "_second"))
    once = F.coalesce(F.col("_at"), F.lit(0)) == 0
    per_second = flat.groupBy(*groups, "_second").agg(
        F.sum(F.when(once & F.col(a).isNotNull(), 1).otherwise(0)).alias(a_out),
        *[F.sum(F.when(once, F.col(c))).alias(c) for c in sums])
    return per_second.groupBy(*groups).agg(
        F.coalesce(F.sum(a_out), F.lit(0)).cast("bigint").alias(a_out), F.count("_second").alias(b_out),
        *[F.sum(c).alias(c) for c in sums])
