"""Balance of two per-key measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tianguis.functions.numeric import round_half_up


def balance(left: DataFrame, right: DataFrame, key: str, left_measure: str, right_measure: str,
            alias: str = "balance", how: str = "left", digits: int = 2) -> DataFrame:
    """Join two aggregates on ``key`` (``how`` = left keeps only left keys;
    full keeps both) and add round(coalesce(l,0) - coalesce(r,0), digits)."""
    j = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), how)
    lm = F.coalesce(F.col(f"l.{left_measure}"), F.lit(0))
    rm = F.coalesce(F.col(f"r.{right_measure}"), F.lit(0))
    return j.select(F.coalesce(F.col(f"l.{key}"), F.col(f"r.{key}")).alias(key),
                    lm.alias(left_measure), rm.alias(right_measure),
                    round_half_up(lm - rm, digits).alias(alias))
