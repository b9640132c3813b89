"""FIXTURES.md section 3 as common table expressions, plus the cuts the checks share."""

from __future__ import annotations

FIXTURE = {
    "f_orders": """
SELECT o_orderkey AS order_id, o_orderkey AS customer_id,
 CASE o_orderkey % 40 WHEN 0 THEN 'canceled' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'shipped'
      WHEN 3 THEN 'invoiced' WHEN 4 THEN 'processing' ELSE 'delivered' END AS order_status,
 purchase AS order_purchase_timestamp,
 CASE WHEN o_orderkey % 97 = 0 THEN NULL
      ELSE purchase + ((o_orderkey*53) % 2880) * INTERVAL '1' MINUTE END AS order_approved_at,
 CASE WHEN o_orderkey % 89 = 0 THEN NULL
      ELSE purchase + ((o_orderkey*61) % 9000) * INTERVAL '1' MINUTE END AS order_delivered_carrier_date,
 CASE WHEN o_orderkey % 40 < 5 OR o_orderkey % 101 = 0 THEN NULL
      ELSE purchase + ((o_orderkey*61) % 9000 + (o_orderkey*71) % 33120) * INTERVAL '1' MINUTE
      END AS order_delivered_customer_date,
 o_orderdate + (18 + o_orderkey % 13) * INTERVAL '1' DAY AS order_estimated_delivery_date,
 o_custkey, o_orderpriority
FROM (SELECT *, o_orderdate + ((o_orderkey*37) % 1440) * INTERVAL '1' MINUTE AS purchase FROM orders) b""",
    "f_items": """
SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, seller_id,
 o_orderdate + CASE WHEN seller_id % 4 = 0
                      OR (seller_id % 4 = 1 AND o_orderdate < TIMESTAMP '1998-04-01 00:00:00')
                      OR (seller_id % 4 = 2 AND o_orderdate >= TIMESTAMP '1998-04-01 00:00:00')
                    THEN 9200 ELSE 4000 END * INTERVAL '1' MINUTE AS shipping_limit_date,
 CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
 CAST(CASE WHEN l_partkey % 40 = 9 THEN 0 ELSE CAST(l_quantity AS DECIMAL(12,2))*300 END AS DECIMAL(12,2))
   AS freight_value
FROM (SELECT *, l_suppkey + CASE WHEN l_suppkey % 20 = 3 AND o_orderdate >= TIMESTAMP '1998-04-01 00:00:00'
                            THEN 4 ELSE 0 END AS seller_id
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey) b""",
    "f_customers": """
SELECT o_orderkey AS customer_id, o_custkey*17 + o_orderkey % 17 AS customer_unique_id, r_name AS customer_state
FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "f_sellers": """
SELECT s_suppkey AS seller_id, r_name AS seller_state
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "f_products": """
SELECT p_partkey AS product_id,
 CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_brand END AS product_category_name,
 CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_size*100 END AS product_weight_g,
 p_size AS product_length_cm, 10 AS product_height_cm, 20 AS product_width_cm
FROM part""",
    "f_translation": """
SELECT DISTINCT p_brand AS product_category_name,
 lower(replace(p_brand,'#','_')) AS product_category_name_english
FROM part WHERE p_brand NOT IN ('Brand#3','Brand#7')""",
    "f_payments": """
WITH t AS (SELECT order_id, SUM(price+freight_value) AS total FROM f_items GROUP BY order_id),
 b AS (SELECT o.order_id AS k, o.o_orderpriority AS pr, t.total
       FROM f_orders o JOIN t ON t.order_id = o.order_id WHERE o.order_id % 1000 <> 13)
SELECT k AS order_id, 1 AS payment_sequential,
  CASE WHEN k % 500 = 7 THEN 'not_defined' WHEN pr IN ('1-URGENT','3-MEDIUM') THEN 'credit_card'
       WHEN pr = '2-HIGH' THEN 'boleto' WHEN pr = '5-LOW' THEN 'debit_card' ELSE 'voucher' END AS payment_type,
  CAST(total - CASE WHEN k % 10 = 3 THEN 100 ELSE 0 END + CASE WHEN k % 100 = 11 THEN 5 ELSE 0 END
       AS DECIMAL(14,2)) AS payment_value FROM b
UNION ALL SELECT k, 2, 'voucher', CAST(50 AS DECIMAL(14,2)) FROM b WHERE k % 10 = 3
UNION ALL SELECT k, 3, 'voucher', CAST(50 AS DECIMAL(14,2)) FROM b WHERE k % 10 = 3""",
    "f_reviews": """
WITH s AS (SELECT order_id AS k,
   CASE WHEN order_id % 23 = 0 THEN 1
        WHEN CAST(order_delivered_customer_date AS DATE) > CAST(order_estimated_delivery_date AS DATE)
        THEN 1 + order_id % 3 ELSE 3 + order_id % 3 END AS sc,
   CAST(order_estimated_delivery_date AS DATE) AS d FROM f_orders WHERE order_id % 60 <> 7)
SELECT k AS order_id, CAST(sc AS INT) AS review_score, d AS review_creation_date FROM s
UNION ALL SELECT k, CAST(CASE WHEN sc = 1 THEN 2 ELSE 6 - sc END AS INT), d FROM s WHERE k % 50 = 5""",
    # One score per order.
    "scores": """
SELECT order_id, CAST(AVG(CAST(review_score AS DOUBLE)) AS DECIMAL(14,4)) AS score
FROM f_reviews GROUP BY order_id""",
    # Orders with their quarter and flags; half_year are those bought in either quarter.
    "o": """
SELECT *, order_status = 'delivered' AS delivered,
  CAST(order_delivered_customer_date AS DATE) > CAST(order_estimated_delivery_date AS DATE) AS late,
  CAST(order_delivered_customer_date AS DATE) <= CAST(order_estimated_delivery_date AS DATE) AS punctual,
  CASE WHEN order_purchase_timestamp >= TIMESTAMP '1998-01-01'
        AND order_purchase_timestamp < TIMESTAMP '1998-07-01'
       THEN CASE WHEN order_purchase_timestamp < TIMESTAMP '1998-04-01' THEN '1998-Q1' ELSE '1998-Q2' END
  END AS purchase_quarter
FROM f_orders""",
    "half_year": "SELECT * FROM o WHERE purchase_quarter IS NOT NULL",
    # Items of orders that were delivered, with a carrier handover, in either quarter.
    "dispatched": """
SELECT h.*, i.* EXCLUDE (order_id),
  order_delivered_carrier_date > shipping_limit_date AS breach,
  order_delivered_carrier_date <= shipping_limit_date AS prompt
FROM half_year h JOIN f_items i USING (order_id)
WHERE delivered AND order_delivered_carrier_date IS NOT NULL""",
    "matrix": """
SELECT *, CASE WHEN prompt AND punctual THEN '01_clean_delivery' WHEN breach AND punctual THEN '02_carrier_rescue'
               WHEN prompt AND late THEN '03_carrier_delay' WHEN breach AND late THEN '04_seller_delay'
               ELSE 'unclassified' END AS fulfillment_attribution
FROM dispatched WHERE purchase_quarter = '1998-Q2' AND order_delivered_customer_date IS NOT NULL""",
    "seller_quarters": """
SELECT seller_id,
  COUNT(*) FILTER (WHERE purchase_quarter = '1998-Q1') AS q1_total_items,
  COUNT(*) FILTER (WHERE purchase_quarter = '1998-Q1' AND breach) AS q1_breaches,
  COUNT(*) FILTER (WHERE purchase_quarter = '1998-Q2') AS q2_total_items,
  COUNT(*) FILTER (WHERE purchase_quarter = '1998-Q2' AND breach) AS q2_breaches,
  COUNT(*) FILTER (WHERE purchase_quarter = '1998-Q2' AND breach AND late) AS q2_direct_customer_delays
FROM dispatched GROUP BY seller_id""",
    "seller_history": """
SELECT * FROM seller_quarters
WHERE (q1_total_items >= 10 AND q1_breaches > 0) OR (q2_total_items >= 10 AND q2_breaches > 0)""",
    # Items sold in either quarter, and their routes.
    "sold": """
SELECT h.*, i.* EXCLUDE (order_id), freight_value >= price AS toxic
FROM half_year h JOIN f_items i USING (order_id) WHERE delivered""",
    "routes": """
SELECT s.*, c.customer_state, v.seller_state,
  CASE WHEN v.seller_state <> c.customer_state THEN 'Interstate' ELSE 'Local' END AS shipping_type
FROM sold s JOIN f_sellers v USING (seller_id) JOIN f_customers c USING (customer_id)""",
    # People and how they started.
    "history": """
SELECT customer_unique_id, order_id, order_purchase_timestamp,
  ROW_NUMBER() OVER (PARTITION BY customer_unique_id ORDER BY order_purchase_timestamp, order_id) AS order_no,
  COUNT(*) OVER (PARTITION BY customer_unique_id) AS total_orders
FROM o JOIN f_customers USING (customer_id) WHERE delivered""",
    "labels_of": """
SELECT p.*, COALESCE(t.product_category_name_english, p.product_category_name, 'unlabeled') AS category_name
FROM f_products p LEFT JOIN f_translation t USING (product_category_name)""",
    "main_payment": """
SELECT order_id, payment_type, payment_value FROM f_payments
QUALIFY ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY payment_value DESC, payment_type) = 1""",
    "main_category": """
SELECT order_id, category_name, price FROM f_items JOIN labels_of USING (product_id)
QUALIFY ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY price DESC, order_item_id, category_name) = 1""",
    "category_starts": """
SELECT m.category_name, h.* FROM history h JOIN main_category m USING (order_id) WHERE order_no = 1""",
    "punctual_reviews": """
SELECT DISTINCT s.order_id, l.category_name, r.score
FROM sold s JOIN labels_of l USING (product_id) JOIN scores r USING (order_id) WHERE s.punctual""",
}


def with_fixture(select: str, tables_exist: bool = False) -> str:
    """A statement over the fixture; DuckDB runs only the parts it refers to.

    ``tables_exist`` leaves out the marketplace tables themselves, to be run where they are real tables.
    """
    wanted = {n: text for n, text in FIXTURE.items() if not (tables_exist and n.startswith("f_"))}
    parts = ",\n".join(f"{name} AS ({text.strip()})" for name, text in wanted.items())
    own = select.strip()
    return f"WITH {parts},\n{own[5:]}" if own.startswith("WITH ") else f"WITH {parts}\n{own}"


def cents(value: str) -> str:
    """Two decimals, half away from zero. Binary noise is cut off first, so that 1.005 becomes 1.01."""
    return f"CAST(ROUND(CAST({value} AS DECIMAL(38,10)), 2) AS DOUBLE)"


def pct(part: str, whole: str) -> str:
    return cents(f"100 * CAST({part} AS DOUBLE) / NULLIF(CAST({whole} AS DOUBLE), 0)")


def per(total: str, n: str) -> str:
    return cents(f"CAST({total} AS DOUBLE) / NULLIF(CAST({n} AS DOUBLE), 0)")


def big(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


def dbl(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"
