"""Consolidation: one row per key of a child table, restricted to in-scope parents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Agg:
    """A decomposable aggregate: ``kind`` in sum | count | max | min over ``expr``
    (``expr`` None with kind count means COUNT(*))."""

    kind: str
    expr: Column | str | None = None

    def col(self) -> Column:
        if self.expr is None:
            return F.lit(1)
        return F.col(self.expr) if isinstance(self.expr, str) else self.expr


def consolidate(child: DataFrame, parent: DataFrame, key: str | list[str], aggs: dict[str, Agg],
                by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Equivalent of ``SELECT key, by, aggs FROM child JOIN parent USING (key) GROUP BY key, by``
    (``by`` are further grouping columns of the child).

    Plan: aggregate the child per key first (partial aggregation runs map-side,
    so a hot key is collapsed before the shuffle), count the parent rows per
    key, and join the two aggregates; both are hash-partitioned on the key, so
    the join adds no exchange. SUM and COUNT are multiplied by the parent
    multiplicity, so the result equals join-then-aggregate even when parent keys
    repeat."""
    keys = [key] if isinstance(key, str) else list(key)
    partial = []
    for alias, a in aggs.items():
        c = a.col()
        if a.kind == "sum":
            partial.append(F.sum(c).alias(alias))
        elif a.kind == "count":
            partial.append(F.count(c).alias(alias))
        elif a.kind == "max":
            partial.append(F.max(c).alias(alias))
        elif a.kind == "min":
            partial.append(F.min(c).alias(alias))
        else:
            raise ValueError(f"unsupported aggregate kind {a.kind!r}")
    per_key = child.groupBy(*keys, *by).agg(*partial)
    mult = parent.groupBy(*keys).agg(F.count(F.lit(1)).alias("__mult"))
    joined = per_key.join(mult, keys, "inner")
    out = []
    for alias, a in aggs.items():
        if a.kind in ("sum", "count"):
            out.append((F.col(alias) * F.col("__mult")).alias(alias))
        else:
            out.append(F.col(alias))
    return joined.select(*keys, *by, *out)
