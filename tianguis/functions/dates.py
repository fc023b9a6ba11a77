"""Date expressions on TIMESTAMP_NTZ columns. Names are built from the fields
(year, month, weekday), as formatting a timestamp would go through the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tianguis.functions.numeric import _c, ColumnOrName

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def ts_literal(value: str) -> Column:
    """Typed TIMESTAMP_NTZ literal, so comparisons stay on the raw column and push down."""
    text = value if " " in value else value + " 00:00:00"
    return F.lit(text).cast("timestamp_ntz")


def days_between(end: ColumnOrName, start: ColumnOrName) -> Column:
    """Whole calendar days from start to end (time of day ignored), signed."""
    return F.datediff(_c(end), _c(start))


def _named(number: Column, names: tuple[str, ...]) -> Column:
    """The name with a number from 1."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), number)


def _year(ts: ColumnOrName) -> Column:
    return F.lpad(F.year(_c(ts)).cast("string"), 4, "0")


def year_month(ts: ColumnOrName) -> Column:
    """'YYYY-MM'."""
    return F.concat(_year(ts), F.lit("-"), F.lpad(F.month(_c(ts)).cast("string"), 2, "0"))


def month_label(ts: ColumnOrName) -> Column:
    """English 'Mon YYYY', e.g. 'Nov 2017'."""
    return F.concat(_named(F.month(_c(ts)), MONTHS), F.lit(" "), _year(ts))


def weekday_name(ts: ColumnOrName) -> Column:
    """Full English weekday name, e.g. 'Monday'."""
    return _named(F.dayofweek(_c(ts)), WEEKDAYS)


def weekday_number(ts: ColumnOrName) -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(_c(ts)).cast("bigint")


def week_monday_first(ts: ColumnOrName) -> Column:
    """Week of the year, weeks start on Monday, numbered 0..53; week 1 is the
    first week with four or more days in the year (days before it are week 0).
    """
    t = _c(ts)
    jan1_weekday = F.weekday(F.trunc(F.to_date(t), "year"))  # Monday = 0
    base = F.floor((F.dayofyear(t) + jan1_weekday - F.lit(1)) / F.lit(7))
    return (base + F.when(jan1_weekday <= 3, F.lit(1)).otherwise(F.lit(0))).cast("bigint")
