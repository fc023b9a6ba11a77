"""Load the marketplace tables from Parquet or CSV files with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tianguis.sources.model import Marketplace
from tianguis.sources.schema import OPTIONAL, SCHEMAS

_FIELDS = {
    "orders": "orders", "order_items": "items", "order_payments": "payments",
    "customers": "customers", "order_reviews": "reviews", "products": "products",
    "sellers": "sellers", "category_translation": "translation",
}


def _read(spark: SparkSession, path: str, name: str, fmt: str) -> DataFrame:
    """One table with its declared columns, in the declared order and types,
    whatever their order in the file. A missing column is an error.

    CSV files have a header row; quoted fields may hold line breaks and doubled
    quotes. Such a file cannot be split: keep many files, or convert to Parquet once."""
    schema = SCHEMAS[name]
    if fmt == "csv":
        options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": "FAILFAST",
                   "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}
        found = spark.read.options(**options).csv(path)
        # every field as text first, by name; an empty field is NULL
        df = found.select([F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in found.columns])
        kinds = {f.name: f.dataType for f in schema.fields}

        def typed(c: str):
            if isinstance(kinds[c], T.TimestampNTZType):
                return F.to_timestamp_ntz(F.col(c), F.lit("yyyy-MM-dd HH:mm:ss"))
            return F.col(c).cast(kinds[c])
    elif fmt == "parquet":
        df = spark.read.parquet(path)
        kinds = {f.name: f.dataType for f in schema.fields}

        def typed(c: str):
            return F.col(c).cast(kinds[c])
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    missing = [f.name for f in schema.fields if f.name not in df.columns and f.name not in OPTIONAL.get(name, ())]
    if missing:
        raise ValueError(f"{name}: columns missing in {path}: {missing}")
    return df.select([typed(f.name).alias(f.name) for f in schema.fields if f.name in df.columns])


def load_tables(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet",
                fold_case: tuple[str, ...] = (), collate: tuple[str, ...] = (),
                collation: str = "UNICODE_CI_AI") -> Marketplace:
    """``paths`` maps each table name of ``schema.SCHEMAS`` to a file or directory.
    Text columns named in ``fold_case`` are trimmed and lower-cased in every table,
    for keys that sources write in mixed case. Those named in ``collate`` keep their
    spelling but get ``collation`` (by default without case and accents), in which joins, groupings,
    comparisons and orders by them are then made; of the spellings of one group, any may be shown."""
    missing = set(_FIELDS) - set(paths)
    if missing:
        raise ValueError(f"missing table paths: {sorted(missing)}")
    dfs = {_FIELDS[n]: _read(spark, p, n, fmt) for n, p in paths.items() if n in _FIELDS}
    if fold_case:
        dfs = {k: df.select([F.lower(F.trim(c)).alias(c) if c in fold_case else F.col(c) for c in df.columns])
               for k, df in dfs.items()}
    if collate:
        dfs = {k: df.select([F.collate(c, collation).alias(c) if c in collate else F.col(c) for c in df.columns])
               for k, df in dfs.items()}
    return Marketplace(**dfs)
