"""Band and rule generators: ordered CASE WHEN chains built from parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tianguis.functions.numeric import _c, ColumnOrName


@dataclass(frozen=True)
class Band:
    """``low <= x <= high`` (either side open when None); ``above`` means ``x > above``."""

    label: str
    low: float | None = None
    high: float | None = None
    above: float | None = None

    def test(self, x: Column) -> Column:
        cond = F.lit(True)
        if self.low is not None:
            cond = cond & (x >= F.lit(self.low))
        if self.high is not None:
            cond = cond & (x <= F.lit(self.high))
        if self.above is not None:
            cond = cond & (x > F.lit(self.above))
        return cond


def check_bands(name: str, bands: Sequence[Band]) -> None:
    """Bands over whole numbers, in ascending order: none empty or unlabelled, no label twice,
    no overlap and no gap between the first edge and the last. ValueError otherwise."""
    if not bands:
        raise ValueError(f"{name}: no band")
    if len({b.label for b in bands}) < len(bands) or not all(b.label for b in bands):
        raise ValueError(f"{name}: labels must be given and differ")
    at = None  # the smallest whole number not yet covered
    for i, b in enumerate(bands):
        low = b.low if b.above is None else b.above + 1
        if b.low is not None and b.above is not None:
            raise ValueError(f"{name}: {b.label!r} has two lower edges")
        if i and (low is None or at is None):
            raise ValueError(f"{name}: {b.label!r} overlaps the band before it, one of them has no edge between them")
        if i and low != at:
            raise ValueError(f"{name}: {'overlap' if low < at else 'gap'} before {b.label!r}: it starts at {low:g}, expected {at:g}")
        if low is not None and b.high is not None and b.high < low:
            raise ValueError(f"{name}: {b.label!r} is empty")
        at = None if b.high is None else b.high + 1


def bucketize(x: ColumnOrName, bands: Sequence[Band], default: str | None = None) -> Column:
    """First matching band's label; ``default`` (or NULL when None) otherwise.

    A NULL input matches no band, so it gets the default, as in SQL CASE.
    """
    col = _c(x)
    expr = None
    for b in bands:
        expr = F.when(b.test(col), F.lit(b.label)) if expr is None else expr.when(b.test(col), F.lit(b.label))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default)) if default is not None else expr


def classify(rules: list[tuple[str, Column]], default: str) -> Column:
    """Ordered rules with SQL three-valued logic: a rule whose test is NULL does not fire."""
    expr = None
    for label, cond in rules:
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))
