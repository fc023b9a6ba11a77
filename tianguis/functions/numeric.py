"""Numeric rules: one rounding rule, NULL-safe division, exact means.

Every rounded output goes through ``round_half_up``: the value is first fixed
to DECIMAL(38,10) and then rounded half away from zero, so results do not
depend on binary floating point noise (``round(1.005, 2)`` is 1.01). Money
sums stay DECIMAL until the output edge; a mean is the exact sum cast to
DOUBLE divided by the count of non-NULL values, and a division by zero yields
NULL instead of an error.

When the inputs are plain column names the helpers build the expression as one
SQL snippet (a single round trip to the JVM while the plan is built); given
Columns they compose Column objects. Both spell the same expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql(x: ColumnOrName) -> str | None:
    """SQL text of a plain column name, or of a Column built here from SQL text."""
    if isinstance(x, str):
        return _q(x)
    # (Column.__getattr__ turns unknown names into struct-field access: read the dict)
    return vars(x).get("_tianguis_sql")


def _expr(text: str) -> Column:
    col = F.expr(text)
    col._tianguis_sql = f"({text})"
    return col


def round_dec(e: ColumnOrName, digits: int) -> Column:
    """Round half away from zero, keeping a DECIMAL(38, digits)."""
    t = _sql(e)
    if t is not None:
        return _expr(f"ROUND(CAST({t} AS DECIMAL(38,10)), {int(digits)})")
    return F.round(e.cast("decimal(38,10)"), digits)


def round_half_up(e: ColumnOrName, digits: int) -> Column:
    """Round half away from zero and return DOUBLE (the output type of rounded values)."""
    t = _sql(e)
    if t is not None:
        return _expr(f"CAST(ROUND(CAST({t} AS DECIMAL(38,10)), {int(digits)}) AS DOUBLE)")
    return round_dec(e, digits).cast("double")


def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / den in DOUBLE, NULL when den is 0 or NULL."""
    a, b = _sql(num), _sql(den)
    if a is not None and b is not None:
        return _expr(f"CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0.0D)")
    return _c(num).cast("double") / F.nullif(_c(den).cast("double"), F.lit(0.0))


def pct(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num * 100 / den in DOUBLE, NULL when den is 0 or NULL."""
    a, b = _sql(num), _sql(den)
    if a is not None and b is not None:
        return _expr(f"CAST({a} AS DOUBLE) * 100.0D / NULLIF(CAST({b} AS DOUBLE), 0.0D)")
    return (_c(num).cast("double") * F.lit(100.0)) / F.nullif(_c(den).cast("double"), F.lit(0.0))


def mean(x: ColumnOrName) -> Column:
    """AVG(x) as exact SUM cast to DOUBLE over COUNT(x); NULLs are skipped."""
    t = _sql(x)
    if t is not None:
        return _expr(f"CAST(SUM({t}) AS DOUBLE) / NULLIF(CAST(COUNT({t}) AS DOUBLE), 0.0D)")
    return safe_div(F.sum(x), F.count(x))
