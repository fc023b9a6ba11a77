"""Explicit schemas of the eight marketplace tables (never inferred).

Identifiers are strings in the production data (anonymous hashes); the
operators only compare them for equality, so any key type works (the test
fixture uses BIGINT keys). Money is DECIMAL(18,2) from the load step on, so
sums are exact and independent of partitioning; timestamps carry no zone.
"""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
TS = T.TimestampNTZType()
S = T.StringType()

ORDERS = T.StructType([
    T.StructField("order_id", S),
    T.StructField("customer_id", S),
    T.StructField("order_status", S),
    T.StructField("order_purchase_timestamp", TS),
    T.StructField("order_approved_at", TS),
    T.StructField("order_delivered_carrier_date", TS),
    T.StructField("order_delivered_customer_date", TS),
    T.StructField("order_estimated_delivery_date", TS),
])

ORDER_ITEMS = T.StructType([
    T.StructField("order_id", S),
    T.StructField("order_item_id", T.IntegerType()),
    T.StructField("product_id", S),
    T.StructField("seller_id", S),
    T.StructField("shipping_limit_date", TS),
    T.StructField("price", MONEY),
    T.StructField("freight_value", MONEY),
])

ORDER_PAYMENTS = T.StructType([
    T.StructField("order_id", S),
    T.StructField("payment_sequential", T.IntegerType()),
    T.StructField("payment_type", S),
    T.StructField("payment_installments", T.IntegerType()),
    T.StructField("payment_value", MONEY),
])

CUSTOMERS = T.StructType([
    T.StructField("customer_id", S),
    T.StructField("customer_unique_id", S),
    T.StructField("customer_zip_code_prefix", S),
    T.StructField("customer_city", S),
    T.StructField("customer_state", S),
])

ORDER_REVIEWS = T.StructType([
    T.StructField("review_id", S),
    T.StructField("order_id", S),
    T.StructField("review_score", T.IntegerType()),
    T.StructField("review_comment_title", S),
    T.StructField("review_comment_message", S),
    T.StructField("review_creation_date", TS),
    T.StructField("review_answer_timestamp", TS),
])

PRODUCTS = T.StructType([
    T.StructField("product_id", S),
    T.StructField("product_category_name", S),
    T.StructField("product_name_lenght", T.IntegerType()),
    T.StructField("product_description_lenght", T.IntegerType()),
    T.StructField("product_photos_qty", T.IntegerType()),
    T.StructField("product_weight_g", T.IntegerType()),
    T.StructField("product_length_cm", T.IntegerType()),
    T.StructField("product_height_cm", T.IntegerType()),
    T.StructField("product_width_cm", T.IntegerType()),
])

SELLERS = T.StructType([
    T.StructField("seller_id", S),
    T.StructField("seller_zip_code_prefix", S),
    T.StructField("seller_city", S),
    T.StructField("seller_state", S),
])

CATEGORY_TRANSLATION = T.StructType([
    T.StructField("product_category_name", S),
    T.StructField("product_category_name_english", S),
])

SCHEMAS = {
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "order_payments": ORDER_PAYMENTS,
    "customers": CUSTOMERS,
    "order_reviews": ORDER_REVIEWS,
    "products": PRODUCTS,
    "sellers": SELLERS,
    "category_translation": CATEGORY_TRANSLATION,
}

#: Columns that no analysis reads; files may leave them out.
OPTIONAL = {
    "order_items": {"shipping_limit_date"},
    "customers": {"customer_zip_code_prefix", "customer_city"},
    "order_reviews": {"review_id", "review_creation_date", "review_answer_timestamp"},
    "products": {"product_name_lenght", "product_description_lenght", "product_photos_qty",
                 "product_length_cm", "product_height_cm", "product_width_cm"},
    "sellers": {"seller_zip_code_prefix", "seller_city"},
}
