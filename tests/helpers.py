"""Small hand-made marketplaces for edge-case tests (production schemas, string ids)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import SparkSession

from tianguis.sources.model import Marketplace
from tianguis.sources.schema import SCHEMAS

FIELDS = {"orders": "orders", "order_items": "items", "order_payments": "payments", "customers": "customers",
          "order_reviews": "reviews", "products": "products", "sellers": "sellers",
          "category_translation": "translation"}


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def money(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def table(spark: SparkSession, name: str, rows: list[dict]):
    schema = SCHEMAS[name]
    data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(data, schema)


def marketplace(spark: SparkSession, **tables: list[dict]) -> Marketplace:
    dfs = {}
    for name, field in FIELDS.items():
        dfs[field] = table(spark, name, tables.get(field, []))
    return Marketplace(**dfs)


def order(oid: str, status: str = "delivered", pts: str = "2017-05-01 10:00:00", delivered: str | None = None,
          estimated: str | None = None, customer: str | None = None) -> dict:
    return {"order_id": oid, "customer_id": customer or f"c{oid}", "order_status": status,
            "order_purchase_timestamp": ts(pts),
            "order_approved_at": ts(pts),
            "order_delivered_carrier_date": ts(pts) if status == "delivered" else None,
            "order_delivered_customer_date": ts(delivered) if delivered else None,
            "order_estimated_delivery_date": ts(estimated) if estimated else None}


def item(oid: str, n: int = 1, price=10, freight=1, product: str = "p1", seller: str = "s1") -> dict:
    return {"order_id": oid, "order_item_id": n, "product_id": product, "seller_id": seller,
            "price": money(price), "freight_value": money(freight)}


def payment(oid: str, value, kind: str = "credit_card", seq: int = 1, inst: int = 1) -> dict:
    return {"order_id": oid, "payment_sequential": seq, "payment_type": kind,
            "payment_installments": inst, "payment_value": money(value)}


def review(oid: str, score: int | None, rid: str | None = None) -> dict:
    return {"review_id": rid or f"r{oid}{score}", "order_id": oid, "review_score": score}
