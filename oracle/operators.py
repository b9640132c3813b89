"""Checks for single operators and for the way through files."""

from __future__ import annotations

from oracle.fixture import big, cents, dbl, pct, per, with_fixture

_VALUE = "CAST(l_extendedprice AS DECIMAL(12,2))"
_COUNTED = {
    "customers": "f_customers",
    "orders": "f_orders",
    "order_items": "f_items",
    "order_payments": "f_payments",
    "order_reviews": "f_reviews",
    "products": "f_products",
    "sellers": "f_sellers",
    "geolocation": "nation",
    "category_translation": "f_translation",
}
_AMOUNT = {"order_items": "SUM(price)", "order_payments": "SUM(payment_value)"}
_ORDER_TIMES = """order_purchase_timestamp, order_approved_at, order_delivered_carrier_date,
  order_delivered_customer_date, order_estimated_delivery_date"""

OPERATOR_SQL: dict[str, str] = {
    "s1_s3_load_round_trip": with_fixture(
        " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, COUNT(*) AS row_count, {dbl(_AMOUNT.get(name, '0'))} AS amount FROM {part}"
            for name, part in _COUNTED.items()
        )
    ),
    "s4_stored_orders": with_fixture(f"SELECT order_id, order_status, {_ORDER_TIMES} FROM half_year WHERE delivered"),
    "s6_bucketed_join": with_fixture("SELECT * FROM seller_quarters"),
    "s5_export_round_trip": with_fixture(f"""
SELECT purchase_quarter, shipping_type, COUNT(*) AS total_items, COUNT(*) FILTER (WHERE toxic) AS toxic_item,
  {pct('COUNT(*) FILTER (WHERE toxic)', 'COUNT(*)')} AS toxic_item_pct,
  {dbl('COALESCE(SUM(freight_value) FILTER (WHERE toxic), 0)')} AS total_toxic_freight_value,
  {per('SUM(freight_value) FILTER (WHERE toxic)', 'COUNT(*) FILTER (WHERE toxic)')} AS avg_toxic_freight
FROM routes GROUP BY ALL"""),
    "e1_period_bucket": """
SELECT CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1996 THEN '1995-96'
            WHEN year(o_orderdate) IN (1997, 1999) THEN CAST(year(o_orderdate) AS VARCHAR) END AS span,
  COUNT(*) AS orders FROM orders GROUP BY ALL""",
    "e2_order_rules": with_fixture("""
SELECT CASE WHEN prompt AND punctual THEN '01_clean_delivery' WHEN breach AND punctual THEN '02_carrier_rescue'
            WHEN prompt AND late THEN '03_carrier_delay' WHEN breach AND late THEN '04_seller_delay'
            ELSE 'unclassified' END AS fulfillment_attribution,
  CASE WHEN late THEN 'delay' ELSE 'on time' END AS delivery_status, COUNT(*) AS items,
  COUNT(*) FILTER (WHERE late) AS late, COUNT(*) FILTER (WHERE breach) AS breach
FROM (SELECT late, punctual, order_delivered_carrier_date > shipping_limit_date AS breach,
        order_delivered_carrier_date <= shipping_limit_date AS prompt
      FROM o JOIN f_items USING (order_id))
GROUP BY fulfillment_attribution, delivery_status"""),
    "e3_one_per_order": f"""
SELECT l_orderkey, COUNT(*) AS lines, {dbl(f'SUM({_VALUE})')} AS line_value FROM lineitem GROUP BY l_orderkey""",
    "e4_distinct_pairs": "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem",
    "e5_ratios": f"""
SELECT l_returnflag, {pct("COUNT(*) FILTER (WHERE l_linestatus = 'O')", 'COUNT(*)')} AS open_pct,
  {pct('SUM(CAST(l_quantity AS DECIMAL(12,2)))', f'SUM({_VALUE})')} AS quantity_per_100,
  {pct('COUNT(*)', '0')} AS none_pct
FROM lineitem GROUP BY l_returnflag""",
    "e6_conditional_metrics": f"""
SELECT l_suppkey, COUNT(*) AS lines, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS returned_lines,
  {dbl(f"COALESCE(SUM({_VALUE}) FILTER (WHERE l_returnflag = 'R'), 0)")} AS returned_value,
  {cents("AVG(CAST(l_quantity AS DECIMAL(12,2))) FILTER (WHERE l_returnflag = 'R')")} AS avg_returned_quantity
FROM lineitem GROUP BY l_suppkey""",
    "e7_share_of_total": f"""
SELECT l_suppkey, {pct(f'SUM({_VALUE})', f'(SELECT SUM({_VALUE}) FROM lineitem)')} AS value_share_pct
FROM lineitem GROUP BY l_suppkey""",
    "e8_dense_rank_desc": """
SELECT o_custkey, COUNT(*) AS orders, DENSE_RANK() OVER (ORDER BY COUNT(*) DESC) AS order_rank
FROM orders GROUP BY o_custkey""",
    "e9_main_record": f"""
SELECT l_orderkey, l_partkey, l_suppkey, {dbl(_VALUE)} AS line_value FROM lineitem
QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {_VALUE} DESC, l_partkey, l_suppkey) = 1""",
    "e10_first_record_with_total": """
SELECT o_custkey, o_orderkey, o_orderdate, total_orders FROM (
  SELECT *, COUNT(*) OVER (PARTITION BY o_custkey) AS total_orders,
    ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1""",
    "e11_segment_by_rules": """
SELECT c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'owing' WHEN c_acctbal < 1000 THEN 'small'
  WHEN c_acctbal < 8000 THEN 'middle' ELSE 'large' END AS band, COUNT(*) AS customers
FROM customer GROUP BY ALL""",
    "e12_min_support": "SELECT l_partkey, COUNT(*) AS lines FROM lineitem GROUP BY l_partkey HAVING COUNT(*) >= 30",
    "e13_corridor": with_fixture(f"""
SELECT purchase_quarter, seller_state, customer_state, COUNT(*) AS items, {dbl('SUM(price)')} AS price,
  {dbl('SUM(freight_value)')} AS freight FROM routes GROUP BY ALL"""),
    "e14_reconcile_totals": f"""
SELECT COUNT(*) AS total_orders, {big('SUM(CASE WHEN agrees THEN 1 ELSE 0 END)')} AS matched_orders,
  {pct('SUM(CASE WHEN agrees THEN 1 ELSE 0 END)', 'COUNT(*)')} AS matched_pct,
  {big('SUM(line_value * 100)')} AS line_value, {big('SUM(order_value * 100)')} AS order_value
FROM (SELECT l.line_value, o.order_value, ABS(l.line_value - o.order_value) < 100000 AS agrees
  FROM (SELECT l_orderkey, SUM({_VALUE}) AS line_value FROM lineitem GROUP BY l_orderkey) l
  JOIN (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS order_value FROM orders) o
    ON l.l_orderkey = o.o_orderkey)""",
    "e15_cohort_repeat": f"""
SELECT o_orderpriority AS first_priority, COUNT(*) AS total_customers, COUNT(*) FILTER (WHERE total > 1) AS came_back,
  {pct('COUNT(*) FILTER (WHERE total > 1)', 'COUNT(*)')} AS came_back_pct
FROM (SELECT *, COUNT(*) OVER (PARTITION BY o_custkey) AS total,
        ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
WHERE n = 1 AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY o_orderpriority HAVING COUNT(*) >= 10""",
    "e16_category_label": with_fixture("SELECT product_id, category_name FROM labels_of"),
    "e17_scorecard": f"""
SELECT COALESCE(o_orderpriority, 'ALL') AS o_orderpriority, COUNT(*) AS orders,
  {pct("COUNT(*) FILTER (WHERE o_orderstatus = 'F')", 'COUNT(*)')} AS filled_pct,
  {dbl('SUM(CAST(o_totalprice AS DECIMAL(12,2)))')} AS value
FROM orders GROUP BY ROLLUP (o_orderpriority)
HAVING GROUPING(o_orderpriority) = 1 OR o_orderpriority IN ('1-URGENT', '2-HIGH')""",
    "e18_dq_count": f"""
SELECT COUNT(*) AS total_lines,
  {big('SUM(CASE WHEN l_shipdate < o_orderdate THEN 1 ELSE 0 END)')} AS shipped_before_order,
  {big('SUM(CASE WHEN l_extendedprice <= 0 THEN 1 ELSE 0 END)')} AS free
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "e19_distinct_orders": "SELECT l_suppkey, COUNT(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_suppkey",
    "skew_salted_join": f"""
SELECT p_brand, COUNT(*) AS lines, {dbl(f'SUM({_VALUE})')} AS value
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
}
