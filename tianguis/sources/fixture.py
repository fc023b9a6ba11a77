"""Test fixture: marketplace tables derived from the driver's TPC-H-style tables.

The raw test tables have no NULLs, no orphans, no time of day and no payments
or reviews, so a fixed, deterministic mapping (k = o_orderkey) derives the
eight marketplace tables from them. Every column is a plain SQL expression over
one raw row; the whole mapping is lazy twice over: a table is mapped when a plan
first asks for it, and the mapping runs inside the scans of the queries that
use it (columns a query does not read are pruned away by Catalyst).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tianguis.sources.model import Marketplace


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_L, _I, _D, _S, _TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()

# Declared schemas of the raw test tables (only the columns the mapping reads);
# declaring them skips Parquet schema inference, which costs a Spark job per read.
RAW_SCHEMAS = {
    "orders": _schema(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S), ("o_totalprice", _D),
                      ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "lineitem": _schema(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L), ("l_linenumber", _I),
                        ("l_quantity", _D), ("l_extendedprice", _D)),
    "customer": _schema(("c_custkey", _L), ("c_nationkey", _I)),
    "supplier": _schema(("s_suppkey", _L), ("s_nationkey", _I)),
    "part": _schema(("p_partkey", _L), ("p_brand", _S), ("p_size", _I)),
    "nation": _schema(("n_nationkey", _I), ("n_name", _S)),
}

# The mapping, one SQL expression per column.
ORDER_BASE = (
    "o_orderkey AS order_id",
    "o_custkey AS customer_id",
    """CASE WHEN o_orderkey % 40 = 0 THEN 'canceled'
            WHEN o_orderstatus = 'P' AND o_orderkey % 8 = 1 THEN 'shipped'
            ELSE 'delivered' END AS order_status""",
    "o_orderdate + INTERVAL '1' SECOND * CAST((o_orderkey * 7919) % 86400 AS INT) AS order_purchase_timestamp",
    "explode(IF(o_orderkey % 375 = 76, array(1, 2), array(1))) AS _copy",
)
ORDERS = (
    "order_id", "customer_id", "order_status", "order_purchase_timestamp",
    "IF(order_id % 200 = 3, NULL, order_purchase_timestamp + INTERVAL '1' HOUR) AS order_approved_at",
    "IF(order_status = 'delivered', order_purchase_timestamp + INTERVAL '1' DAY, NULL) AS order_delivered_carrier_date",
    """IF(order_status = 'delivered' AND order_id % 500 != 7,
          order_purchase_timestamp
          + make_dt_interval(CAST((order_id * 31) % 30 + IF(order_id % 11 = 0, 25, 0) AS INT)), NULL)
       AS order_delivered_customer_date""",
    """CAST(CAST(order_purchase_timestamp AS DATE) AS TIMESTAMP_NTZ)
       + make_dt_interval(CAST(20 + (order_id * 17) % 20 AS INT)) AS order_estimated_delivery_date""",
)
ITEMS = (
    "IF(l_orderkey % 250 = 51, -l_orderkey, l_orderkey) AS order_id",
    "l_linenumber AS order_item_id",
    "l_partkey AS product_id",
    """l_suppkey * 100 + CASE WHEN l_partkey % 100 < 50 THEN 0 WHEN l_partkey % 100 < 70 THEN 1
                               WHEN l_partkey % 100 < 85 THEN 2 + l_partkey % 3 ELSE l_partkey % 100 END AS seller_id""",
    "CAST(l_extendedprice AS DECIMAL(18,2)) AS price",
    "CAST(CAST(l_quantity AS INT) AS DECIMAL(18,2)) AS freight_value",
)
BY_CARD = "o_orderpriority IN ('1-URGENT', '3-MEDIUM', '4-NOT SPECIFIED')"
FIRST_PAYMENT = (
    "IF(o_orderkey % 500 = 52, -o_orderkey, o_orderkey) AS order_id",
    "1 AS payment_sequential",
    f"""CASE WHEN o_orderkey % 300 = 9 THEN 'not_defined' WHEN {BY_CARD} THEN 'credit_card'
             WHEN o_orderpriority = '2-HIGH' THEN 'boleto' ELSE 'debit_card' END AS payment_type""",
    f"IF({BY_CARD}, CAST(1 + o_orderkey % 10 AS INT), 1) AS payment_installments",
    """CAST(CAST(o_totalprice AS DECIMAL(18,2)) - IF(o_orderkey % 20 = 1, 100.00BD, 0.00BD) AS DECIMAL(18,2))
       AS payment_value""",
)
VOUCHER = (
    "o_orderkey AS order_id", "2 AS payment_sequential", "'voucher' AS payment_type", "1 AS payment_installments",
    "CAST(100 AS DECIMAL(18,2)) AS payment_value",
)
FIRST_REVIEW = (
    "IF(order_id % 400 = 103, -order_id, order_id) AS order_id",
    """CAST(IF(order_delivered_customer_date > order_estimated_delivery_date, 1 + order_id % 3, 4 + order_id % 2) AS INT)
       AS review_score""",
    "IF(order_id % 8 = 0, 't', NULL) AS review_comment_title",
    "IF(order_id % 5 >= 3, 'm', NULL) AS review_comment_message",
)
SECOND_REVIEW = (
    "order_id", "CAST(1 + order_id % 5 AS INT) AS review_score",
    "CAST(NULL AS STRING) AS review_comment_title", "CAST(NULL AS STRING) AS review_comment_message",
)
CUSTOMER_BASE = (
    "c_custkey", "c_nationkey", "explode(IF(c_custkey % 60 = 31, array(1, 2), array(1))) AS _copy",
)
CUSTOMERS = (
    "c_custkey AS customer_id",
    "IF(c_custkey % 10 = 0, c_custkey + 1, c_custkey) AS customer_unique_id",
    "n_name AS customer_state",
)
PRODUCTS = (
    "p_partkey AS product_id",
    "IF(p_partkey % 50 != 0, p_brand, NULL) AS product_category_name",
    "IF(p_partkey % 1000 != 1, p_size * 100, NULL) AS product_weight_g",
)
TRANSLATION = (
    "p_brand AS product_category_name",
    "lower(replace(p_brand, '#', '_')) AS product_category_name_english",
)


def from_tpch(spark: SparkSession, sf_dir: str) -> Marketplace:
    """Derive the marketplace tables from ``{sf_dir}/{orders,lineitem,...}.parquet``,
    each when it is first asked for."""
    read: dict[str, DataFrame] = {}

    def raw(name: str) -> DataFrame:
        if name not in read:
            read[name] = spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
        return read[name]

    def orders() -> DataFrame:
        return raw("orders").selectExpr(*ORDER_BASE).selectExpr(*ORDERS)

    def payments() -> DataFrame:
        first = raw("orders").where("o_orderkey % 1000 != 5").selectExpr(*FIRST_PAYMENT)
        return first.union(raw("orders").where("o_orderkey % 20 = 1").selectExpr(*VOUCHER))

    def reviews() -> DataFrame:
        first = mk.orders.where("order_id % 90 != 4").selectExpr(*FIRST_REVIEW)
        return first.union(mk.orders.where("order_id % 150 = 11").selectExpr(*SECOND_REVIEW))

    def customers() -> DataFrame:
        c = raw("customer").where("c_nationkey != 3").selectExpr(*CUSTOMER_BASE)
        return c.join(raw("nation"), c.c_nationkey == raw("nation").n_nationkey, "inner").selectExpr(*CUSTOMERS)

    def sellers() -> DataFrame:
        ids = mk.items.select("seller_id").distinct().selectExpr("seller_id", "CAST(floor(seller_id / 100.0D) AS BIGINT) AS s_suppkey")
        named = raw("supplier").where("s_nationkey != 4").join(raw("nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
        return ids.join(named, "s_suppkey", "inner").selectExpr("seller_id", "n_name AS seller_state")

    mk = Marketplace(
        orders=orders,
        items=lambda: raw("lineitem").selectExpr(*ITEMS),
        payments=payments,
        customers=customers,
        reviews=reviews,
        products=lambda: raw("part").selectExpr(*PRODUCTS),
        sellers=sellers,
        translation=lambda: raw("part").select("p_brand").distinct()
        .where("p_brand NOT IN ('Brand#11', 'Brand#12')").selectExpr(*TRANSLATION),
    )
    return mk
