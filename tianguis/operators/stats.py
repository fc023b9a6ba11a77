"""Summary statistics with an exact, distributed median, and exact top-k sums.

Spark's exact ``median``/``percentile`` keeps a value->count map of the whole
input in one final task, and ``percentile_approx`` in a global aggregate sends
one quantile summary per task to a single merging task. Here the input is
reduced once, to a histogram of (value, count); ties collapse map-side, so a value
held by a third of all rows is one row. Everything else reads that histogram,
whose exchange is shared:

1. buckets: 256 per power of two, split by sign, so one spans 0.27% of its
   value range. Their running counts give n, the total, min, max and
   the bucket that holds the wanted rank.
2. cells: that bucket, cut into 4,096 equal parts. Their running counts give the cell.
3. values of that cell, in order.

Where an approximate median is asked for, mergeable KLL sketches take its place: one pass,
no histogram; sketches are merged in two levels, so that no task gets one per input task.

Buckets and cells are bounded in number, and a cell holds at most as many values as
fit into 0.27% / 4,096 of the wanted value (for cents, one value in a cell up to
R$ 15,000, 66 at a million), however many rows or keys there are.
The result is exact: no approximation, no sampling.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_OCTAVE = 256
_OFFSET = 1 << 22
CELLS = 4096
#: Groups of tasks whose quantile sketches are merged first.
SKETCH_GROUPS = 256


def value_bucket(x: Column) -> Column:
    """Monotone bucket id: negatives < 0 < positives, 256 buckets per power of two."""
    mag = F.floor(F.log2(F.abs(x).cast("double")) * F.lit(BUCKETS_PER_OCTAVE)).cast("long")
    return (F.when(x > 0, F.lit(_OFFSET) + mag)
             .when(x < 0, -(F.lit(_OFFSET) + mag))
             .otherwise(F.lit(0)).cast("long"))


def _histogram(df: DataFrame, col: str) -> DataFrame:
    """(v, c, k): distinct values with their counts and buckets. The bucket is an
    aggregate, so that choosing one stays above the shared exchange."""
    v = df.select(F.col(col).alias("v")).where(F.col("v").isNotNull())
    return v.groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.max(value_bucket(F.col("v"))).alias("k"))


_WHOLE = ["n", "total", "mn", "mx", "r1", "r2"]


def _holding_ranks(parts: DataFrame, by: str, within: list[str]) -> DataFrame:
    """Of ``parts`` (by, c, s, below, below_s and the columns of the whole input), at most
    two that hold the ranks r1 to r2, with the count and sum of all values before each.
    ``below`` comes in as what lies before the parts' common range (``within``)."""
    run = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(
        "*", (F.col("below") + F.coalesce(F.sum("c").over(run), F.lit(0))).alias("_b"),
        (F.col("below_s") + F.coalesce(F.sum("s").over(run), F.lit(0))).alias("_bs"))
    return (before.where((F.col("_b") + F.col("c") >= F.col("r1")) & (F.col("_b") < F.col("r2")))
            .drop("below", "below_s").withColumnsRenamed({"_b": "below", "_bs": "below_s"}))


def _values_at(h: DataFrame, first: Column, last: Column) -> DataFrame:
    """The one or two distinct values at the ascending ranks first to last
    (expressions of n, at most one apart): v, c, s, below, below_s (count and sum of the
    smaller values) and n, total, mn, mx of the whole input. No row on empty input.

    What is broadcast is at most two rows (buckets, then cells)."""
    sums = [F.sum("c").alias("c"), F.sum(F.col("v") * F.col("c")).alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    every = Window.partitionBy()
    buckets = h.groupBy("k").agg(*sums).select(
        "*", F.lit(0).cast("bigint").alias("below"), (F.col("s") * 0).alias("below_s"),
        F.sum("c").over(every).alias("n"), F.sum("s").over(every).alias("total"),
        F.min("lo").over(every).alias("mn"), F.max("hi").over(every).alias("mx"))
    bucket = _holding_ranks(buckets.withColumns({"r1": first, "r2": last}), "k", []).drop("c", "s")

    lo, hi = F.col("lo").cast("double"), F.col("hi").cast("double")
    share = (F.col("v").cast("double") - lo) / F.nullif(hi - lo, F.lit(0.0))
    cell = F.coalesce(F.least(F.floor(share * CELLS), F.lit(CELLS - 1)), F.lit(0))
    inside = h.join(F.broadcast(bucket), "k").withColumn("cell", cell)
    keep = ["below", "below_s", *_WHOLE]
    cells = inside.groupBy("k", "cell").agg(*sums[:2], *[F.first(c).alias(c) for c in keep])
    chosen = _holding_ranks(cells, "cell", ["k"]).select("k", "cell", F.col("below").alias("b"), F.col("below_s").alias("bs"))

    values = (inside.join(F.broadcast(chosen), ["k", "cell"])
              .select("k", "cell", "v", "c", (F.col("v") * F.col("c")).alias("s"), F.col("b").alias("below"),
                      F.col("bs").alias("below_s"), *_WHOLE))
    return _holding_ranks(values, "v", ["k", "cell"])


def _median_row(df: DataFrame, col: str) -> DataFrame:
    """One row: n, total, mn, mx and the median, the mean of the values at ranks
    floor((n+1)/2) and floor(n/2)+1 (one value or two). NULLs on empty input."""
    n = F.col("n")
    at = _values_at(_histogram(df, col), F.floor((n + 1) / 2), F.floor(n / 2) + 1)
    return at.agg(*[F.max(c).alias(c) for c in ("n", "total", "mn", "mx")],
                  ((F.min("v") + F.max("v")) / F.lit(2)).alias("median"))


def _sketched_row(df: DataFrame, col: str, k: int) -> DataFrame:
    """As ``_median_row``, but with the median read from a KLL sketch of parameter ``k``: a
    value of the input whose rank is off by about 2 / k of the count. The rest stays exact."""
    parts = df.select(F.col(col).alias("v"), F.col(col).cast("double").alias("x"),
                      (F.spark_partition_id() % SKETCH_GROUPS).alias("g")).where(F.col("v").isNotNull())
    some = parts.groupBy("g").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.min("v").alias("mn"),
                                  F.max("v").alias("mx"), F.kll_sketch_agg_double("x", k).alias("sketch"))
    whole = some.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("mn").alias("mn"), F.max("mx").alias("mx"),
                     F.kll_merge_agg_double("sketch", k).alias("sketch"))
    known = F.when(F.col("n") > 0, F.col("sketch"))
    return whole.select("n", "total", "mn", "mx", F.kll_sketch_get_quantile_double(known, F.lit(0.5)).alias("median"))


def value_at(df: DataFrame, col: str, rank: int) -> Any:
    """The value at the ascending ``rank`` (from 1) of ``col``, NULLs left out; None without one."""
    row = _values_at(_histogram(df, col), F.lit(rank), F.lit(rank)).first()
    return row["v"] if row else None


def exact_median(df: DataFrame, col: str) -> DataFrame:
    """One row ``median`` = PERCENTILE_CONT(0.5); NULL on empty input."""
    return _median_row(df, col).select("median")


def median(df: DataFrame, col: str, sketch_k: int = 0) -> DataFrame:
    """One row ``median``: exact, or with ``sketch_k`` from a KLL sketch of that size."""
    return (_sketched_row(df, col, sketch_k) if sketch_k else _median_row(df, col)).select("median")


def summary_stats(df: DataFrame, col: str, sketch_k: int = 0) -> DataFrame:
    """One row: mean (exact sum / count), min, max and median of ``col``; the median is
    exact, or with ``sketch_k`` from a KLL sketch of that size."""
    row = _sketched_row(df, col, sketch_k) if sketch_k else _median_row(df, col)
    return row.select(
        (F.col("total").cast("double") / F.nullif(F.col("n").cast("double"), F.lit(0.0))).alias("mean"),
        F.col("mn").alias("min"), F.col("mx").alias("max"), "median")


def exact_top_sum(df: DataFrame, col: str, fraction: float) -> DataFrame:
    """One row (n, k, top_sum, total) with k = ceil(fraction * n) and top_sum the
    sum of the k largest values (ties at the cut do not change the sum)."""
    rank = F.col("n") - F.ceil(F.col("n") * F.lit(fraction)) + 1     # of the k-th largest value
    at = _values_at(_histogram(df, col), rank, rank)
    t = at.agg(*[F.max(c).alias(c) for c in ("n", "total", "v", "c", "s", "below", "below_s")])
    n = F.coalesce(F.col("n"), F.lit(0))
    k = F.ceil(n * F.lit(fraction))
    # the values above v are all in the top k, the rest of the top k are copies of v
    above_n, above_s = n - F.col("below") - F.col("c"), F.col("total") - F.col("below_s") - F.col("s")
    top = above_s + (k - above_n) * F.col("v")
    return t.select(n.cast("bigint").alias("n"), k.cast("bigint").alias("k"),
                    F.when(k > 0, top).otherwise(F.lit(0)).alias("top_sum"), "total")
