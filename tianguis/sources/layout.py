"""Storage layout for large deployments: the fact tables bucketed by order_id.

Orders, items, payments and reviews all join on ``order_id``. Written as
bucketed tables with the same bucket count, a sort-merge join between any two
of them reads matching buckets side by side and needs no shuffle; the
per-order pre-aggregates of the plans (payments and reviews per order) are then
computed bucket-locally too. Dimensions (customers, products, sellers,
category names) are written as plain tables.

Bucketed tables live in the session catalog (``saveAsTable`` with an explicit
path under the given folder), so on a cluster point ``base_dir`` at shared
storage. Set ``spark.sql.sources.bucketing.enabled`` (on by default).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tianguis.sources.model import Marketplace

FACTS = {"orders": "orders", "items": "order_items", "payments": "order_payments", "reviews": "order_reviews"}
DIMENSIONS = {"customers": "customers", "products": "products", "sellers": "sellers",
              "translation": "category_translation"}


def save_bucketed(spark: SparkSession, mk: Marketplace, base_dir: str, buckets: int,
                  prefix: str = "mk_") -> dict[str, str]:
    """Write the marketplace; returns {field: table name}."""
    names = {}
    for field, name in FACTS.items():
        table = f"{prefix}{name}"
        (getattr(mk, field).write.mode("errorifexists")
         .option("path", f"{base_dir}/{name}")
         .bucketBy(buckets, "order_id").sortBy("order_id")
         .saveAsTable(table))
        names[field] = table
    for field, name in DIMENSIONS.items():
        table = f"{prefix}{name}"
        getattr(mk, field).write.mode("errorifexists").option("path", f"{base_dir}/{name}").saveAsTable(table)
        names[field] = table
    return names


def load_bucketed(spark: SparkSession, names: dict[str, str]) -> Marketplace:
    mk = Marketplace(**{field: spark.read.table(table) for field, table in names.items()})
    mk.bucketed = True
    return mk
