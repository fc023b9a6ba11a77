"""KPI tables: one aggregate row reshaped into (label, value[, note]) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kpi_table(row: DataFrame, entries: list[tuple], label: str, value: str,
              value_type: str = "double", note: str | None = None) -> DataFrame:
    """``entries`` = [(label_text, column_name[, note_text]), ...] over a one-row
    DataFrame; returns one row per entry (a column-API ``stack``)."""
    structs = []
    for e in entries:
        fields = [F.lit(e[0]).alias(label), F.col(e[1]).cast(value_type).alias(value)]
        if note is not None:
            fields.append(F.lit(e[2]).alias(note))
        structs.append(F.struct(*fields))
    cols = [label, value] + ([note] if note is not None else [])
    return row.select(F.explode(F.array(*structs)).alias("kv")).select(*[F.col(f"kv.{c}").alias(c) for c in cols])
