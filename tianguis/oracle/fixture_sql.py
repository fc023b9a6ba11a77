"""The fixture mapping in DuckDB SQL, as CTE definitions (see sources/fixture.py)."""

FIXTURE_CTES = r"""
mk_orders_base AS (
    SELECT o_orderkey AS order_id,
           o_custkey AS customer_id,
           CASE WHEN o_orderkey % 40 = 0 THEN 'canceled'
                WHEN o_orderstatus = 'P' AND o_orderkey % 8 = 1 THEN 'shipped'
                ELSE 'delivered' END AS order_status,
           o_orderdate + INTERVAL '1' SECOND * CAST((o_orderkey * 7919) % 86400 AS INT)
               AS order_purchase_timestamp
    FROM orders JOIN (VALUES (1), (2)) AS copy(nr) ON nr = 1 OR o_orderkey % 375 = 76
),
mk_orders AS (
    SELECT order_id, customer_id, order_status, order_purchase_timestamp,
           CASE WHEN order_id % 200 = 3 THEN NULL
                ELSE order_purchase_timestamp + INTERVAL '1' HOUR END AS order_approved_at,
           CASE WHEN order_status = 'delivered'
                THEN order_purchase_timestamp + INTERVAL '1' DAY END AS order_delivered_carrier_date,
           CASE WHEN order_status = 'delivered' AND order_id % 500 <> 7
                THEN order_purchase_timestamp + INTERVAL '1' DAY
                     * CAST((order_id * 31) % 30 + CASE WHEN order_id % 11 = 0 THEN 25 ELSE 0 END AS INT)
           END AS order_delivered_customer_date,
           CAST(CAST(order_purchase_timestamp AS DATE) AS TIMESTAMP)
               + INTERVAL '1' DAY * CAST(20 + (order_id * 17) % 20 AS INT) AS order_estimated_delivery_date
    FROM mk_orders_base
),
mk_items AS (
    SELECT CASE WHEN l_orderkey % 250 = 51 THEN -l_orderkey ELSE l_orderkey END AS order_id,
           l_linenumber AS order_item_id,
           l_partkey AS product_id,
           l_suppkey * 100 + CASE WHEN l_partkey % 100 < 50 THEN 0
                                  WHEN l_partkey % 100 < 70 THEN 1
                                  WHEN l_partkey % 100 < 85 THEN 2 + l_partkey % 3
                                  ELSE l_partkey % 100 END AS seller_id,
           CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
           CAST(CAST(l_quantity AS INT) AS DECIMAL(18,2)) AS freight_value
    FROM lineitem
),
mk_payments AS (
    SELECT CASE WHEN o_orderkey % 500 = 52 THEN -o_orderkey ELSE o_orderkey END AS order_id,
           1 AS payment_sequential,
           CASE WHEN o_orderkey % 300 = 9 THEN 'not_defined'
                WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM', '4-NOT SPECIFIED') THEN 'credit_card'
                WHEN o_orderpriority = '2-HIGH' THEN 'boleto'
                ELSE 'debit_card' END AS payment_type,
           CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM', '4-NOT SPECIFIED')
                THEN CAST(1 + o_orderkey % 10 AS INT) ELSE 1 END AS payment_installments,
           CAST(CASE WHEN o_orderkey % 20 = 1 THEN CAST(o_totalprice AS DECIMAL(18,2)) - 100.00
                     ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS payment_value
    FROM orders WHERE o_orderkey % 1000 <> 5
    UNION ALL
    SELECT o_orderkey, 2, 'voucher', 1, CAST(100.00 AS DECIMAL(18,2))
    FROM orders WHERE o_orderkey % 20 = 1
),
mk_reviews AS (
    SELECT CASE WHEN order_id % 400 = 103 THEN -order_id ELSE order_id END AS order_id,
           CAST(CASE WHEN order_delivered_customer_date > order_estimated_delivery_date
                     THEN 1 + order_id % 3 ELSE 4 + order_id % 2 END AS INT) AS review_score,
           CASE WHEN order_id % 8 = 0 THEN 't' END AS review_comment_title,
           CASE WHEN order_id % 5 >= 3 THEN 'm' END AS review_comment_message
    FROM mk_orders WHERE order_id % 90 <> 4
    UNION ALL
    SELECT order_id, CAST(1 + order_id % 5 AS INT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
    FROM mk_orders WHERE order_id % 150 = 11
),
mk_customers AS (
    SELECT c_custkey AS customer_id,
           CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 1 ELSE c_custkey END AS customer_unique_id,
           n_name AS customer_state
    FROM customer JOIN nation ON c_nationkey = n_nationkey
         JOIN (VALUES (1), (2)) AS copy(nr) ON nr = 1 OR c_custkey % 60 = 31
    WHERE c_nationkey <> 3
),
mk_sellers AS (
    SELECT i.seller_id, n.n_name AS seller_state
    FROM (SELECT DISTINCT seller_id FROM mk_items) i
    JOIN supplier s ON CAST(FLOOR(i.seller_id / 100.0) AS BIGINT) = s.s_suppkey
    JOIN nation n ON s.s_nationkey = n.n_nationkey
    WHERE s.s_nationkey <> 4
),
mk_products AS (
    SELECT p_partkey AS product_id,
           CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_brand END AS product_category_name,
           CASE WHEN p_partkey % 1000 = 1 THEN NULL ELSE p_size * 100 END AS product_weight_g
    FROM part
),
mk_translation AS (
    SELECT DISTINCT p_brand AS product_category_name,
           lower(replace(p_brand, '#', '_')) AS product_category_name_english
    FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12')
)
"""

