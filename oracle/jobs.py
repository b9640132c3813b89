"""Checks for the analyses and the datasets under them."""

from __future__ import annotations

from oracle.fixture import big, cents, dbl, pct, per, with_fixture
from oracle.operators import OPERATOR_SQL

_ARRIVED = """delivered AND order_delivered_customer_date IS NOT NULL
  AND order_estimated_delivery_date IS NOT NULL"""
_TIMED = """delivered AND order_approved_at IS NOT NULL AND order_delivered_carrier_date IS NOT NULL
  AND order_delivered_customer_date IS NOT NULL
  AND date_diff('day', CAST(order_approved_at AS DATE), CAST(order_delivered_carrier_date AS DATE)) >= 0"""
_STATUS = "CASE WHEN late THEN 'delay' ELSE 'on time' END AS delivery_status"


def _days(start: str, end: str) -> str:
    return f"date_diff('day', CAST({start} AS DATE), CAST({end} AS DATE))"


_LEGS = f"""COUNT(*) AS total_delivered_orders,
  {cents(f"AVG({_days('order_approved_at', 'order_delivered_carrier_date')})")} AS avg_seller_days,
  {cents(f"AVG({_days('order_delivered_carrier_date', 'order_delivered_customer_date')})")} AS avg_carrier_days"""
_LATE_PCT = f"{pct('COUNT(*) FILTER (WHERE late)', 'COUNT(*)')} AS late_order_pct"
_HALF_YEAR_REVIEWS = "review_creation_date >= DATE '1998-01-01' AND review_creation_date < DATE '1998-07-01'"


def _seller_record(quarter: str) -> str:
    return f"""SELECT seller_id, COUNT(*) AS total_items, COUNT(*) FILTER (WHERE breach) AS breached_items,
  COUNT(*) FILTER (WHERE breach AND late) AS direct_customer_delays,
  {pct('COUNT(*) FILTER (WHERE breach)', 'COUNT(*)')} AS breach_items_pct
FROM dispatched WHERE purchase_quarter = '{quarter}' GROUP BY seller_id HAVING COUNT(*) >= 10"""


# The labels of the published segments.
_SEGMENT = """CASE WHEN n = 1 THEN '01_Single_Purchase_Buyer (1x)'
  WHEN n = 2 THEN '02_Repeat_Purchase_Buyer (2x)' ELSE '03_Loyal_Customer (3x+)' END"""
_CAME_BACK = "COUNT(*) FILTER (WHERE total_orders > 1)"
_REPEAT = f"""COUNT(*) AS total_customers, {_CAME_BACK} AS came_back,
  {pct(_CAME_BACK, 'COUNT(*)')} AS came_back_pct"""
_FREIGHT = f"""COUNT(*) AS total_items, {dbl('SUM(freight_value)')} AS total_freight_value,
  {per('SUM(freight_value)', 'COUNT(freight_value)')} AS avg_freight_value,
  {pct('SUM(freight_value)', 'SUM(price)')} AS freight_to_gmv_pct"""
_TOXIC = "COUNT(*) FILTER (WHERE toxic)"
_TOXIC_FREIGHT = "COALESCE(SUM(freight_value) FILTER (WHERE toxic), 0)"
_MINUTES = "date_sub('minute', order_purchase_timestamp, order_approved_at)"

JOB_SQL = {
    "j1_1a_late_rate_by_quarter": f"""
SELECT purchase_quarter, COUNT(*) AS total_delivered_orders, {_LATE_PCT}
FROM half_year WHERE {_ARRIVED} GROUP BY ALL""",
    "j1_1b_promised_vs_actual": f"""
SELECT purchase_quarter, COUNT(*) AS total_delivered_orders,
  {cents(f"AVG({_days('order_purchase_timestamp', 'order_estimated_delivery_date')})")} AS avg_promised_days,
  {cents(f"AVG({_days('order_purchase_timestamp', 'order_delivered_customer_date')})")} AS avg_actual_days
FROM half_year WHERE {_ARRIVED} GROUP BY ALL""",
    "j1_2a_leg_durations": f"SELECT purchase_quarter, {_LEGS} FROM half_year WHERE {_TIMED} GROUP BY ALL",
    "j1_2b_leg_durations_by_lateness": f"""
SELECT purchase_quarter, {_STATUS}, {_LEGS} FROM half_year
WHERE {_TIMED} AND order_estimated_delivery_date IS NOT NULL GROUP BY ALL""",
    "j1_3_review_by_lateness": f"""
SELECT purchase_quarter, {_STATUS}, COUNT(*) AS total_orders, {cents('AVG(score)')} AS avg_review_score
FROM half_year JOIN scores USING (order_id) WHERE {_ARRIVED} GROUP BY ALL""",
    "j1_4_regional_performance": f"""
SELECT customer_state, purchase_quarter, {_LATE_PCT}, COUNT(*) AS total_orders,
  {cents('AVG(score)')} AS avg_review_score
FROM half_year JOIN scores USING (order_id) JOIN f_customers USING (customer_id)
WHERE {_ARRIVED} GROUP BY ALL""",
    "j1_5a_status_review_audit": f"""
SELECT order_status, purchase_quarter, COUNT(*) AS total_orders, {cents('AVG(score)')} AS avg_review_score
FROM half_year LEFT JOIN scores USING (order_id) GROUP BY ALL""",
    "j1_5b_non_delivered_drag": f"""
SELECT purchase_quarter, COUNT(score) AS reviewed_orders, {cents('AVG(score)')} AS avg_score_all_orders,
  {cents('AVG(score) FILTER (WHERE delivered)')} AS avg_score_delivered_only,
  {cents('AVG(score) - AVG(score) FILTER (WHERE delivered)')} AS score_drag
FROM half_year LEFT JOIN scores USING (order_id) GROUP BY ALL""",
    "j1_6_review_intake_by_quarter": f"""
SELECT CASE WHEN review_creation_date < DATE '1998-04-01' THEN '1998-Q1' ELSE '1998-Q2' END AS review_quarter,
  COUNT(*) AS total_reviews, {cents('AVG(review_score)')} AS avg_review_score
FROM f_reviews WHERE {_HALF_YEAR_REVIEWS} GROUP BY ALL""",
    "j1_7_review_intake_by_month": f"""
SELECT strftime(review_creation_date, '%Y-%m') AS review_month, COUNT(*) AS total_reviews,
  {cents('AVG(review_score)')} AS avg_review_score,
  COUNT(*) FILTER (WHERE review_score = 1) AS one_star_reviews,
  {pct('COUNT(*) FILTER (WHERE review_score = 1)', 'COUNT(*)')} AS one_star_pct
FROM f_reviews WHERE {_HALF_YEAR_REVIEWS} GROUP BY ALL""",
    "j1_8_late_rate_by_delivery_month": f"""
SELECT strftime(order_delivered_customer_date, '%Y-%m') AS delivery_month,
  COUNT(*) AS total_delivered_orders, {_LATE_PCT}
FROM o WHERE {_ARRIVED} AND order_delivered_customer_date >= TIMESTAMP '1998-01-01'
  AND order_delivered_customer_date < TIMESTAMP '1998-07-01' GROUP BY ALL""",
    "j2_1_dispatch_baseline": f"""
SELECT purchase_quarter, COUNT(*) AS total_dispatched_items,
  COUNT(*) FILTER (WHERE prompt) AS on_time_dispatches, COUNT(*) FILTER (WHERE breach) AS breached_dispatches,
  {pct('COUNT(*) FILTER (WHERE breach)', 'COUNT(*)')} AS dispatch_breach_pct
FROM dispatched GROUP BY ALL""",
    "j2_2_fulfillment_matrix": f"""
SELECT fulfillment_attribution, COUNT(*) AS total_items,
  {pct('COUNT(*)', '(SELECT COUNT(*) FROM matrix)')} AS pct_of_total
FROM matrix GROUP BY fulfillment_attribution""",
    "j2_3_top_offenders": f"""
SELECT DENSE_RANK() OVER (ORDER BY direct_customer_delays DESC) AS harm_rank, *
FROM ({_seller_record('1998-Q2')}) WHERE direct_customer_delays > 0""",
    "j2_4_top_breachers": f"""
SELECT DENSE_RANK() OVER (ORDER BY breached_items DESC) AS breached_ranks, *
FROM ({_seller_record('1998-Q1')}) WHERE breached_items > 0 ORDER BY breached_items DESC, seller_id LIMIT 10""",
    "j2_5_seller_quarters_filtered": "SELECT * FROM seller_history",
    "j2_6_seller_segments": """
SELECT *, CASE WHEN q2_total_items < 3 AND q1_total_items >= 10 THEN 'exited'
  WHEN LEAST(q1_total_items, q2_total_items) < 10 THEN 'not_enough_data'
  WHEN 10 * q1_breaches >= q1_total_items
  THEN CASE WHEN 10 * q2_breaches >= q2_total_items THEN 'chronic' ELSE 'reformed' END
  WHEN 10 * q2_breaches >= q2_total_items THEN 'got_worse' ELSE 'compliant' END AS seller_segment
FROM seller_history""",
    "j2_7_review_by_bucket": f"""
SELECT fulfillment_attribution, COUNT(*) AS reviewed_items, {cents('AVG(score)')} AS avg_review_score,
  {pct('COUNT(*) FILTER (WHERE score < 2)', 'COUNT(*)')} AS one_star_pct
FROM matrix JOIN scores USING (order_id) GROUP BY ALL""",
    "j2_8_review_by_seller_group": f"""
SELECT CASE WHEN q2_total_items < 10 THEN '03_small_seller'
            WHEN 10 * q2_breaches >= q2_total_items THEN '01_high_breach_seller'
            ELSE '02_normal_seller' END AS seller_group,
  COUNT(DISTINCT seller_id) AS sellers, COUNT(*) AS reviewed_items, {cents('AVG(score)')} AS avg_review_score,
  {pct('COUNT(*) FILTER (WHERE score < 2)', 'COUNT(*)')} AS one_star_pct
FROM dispatched JOIN seller_quarters USING (seller_id) JOIN scores USING (order_id)
WHERE purchase_quarter = '1998-Q2' GROUP BY ALL""",
    "j2_9_dq_carrier_before_approval": """
SELECT COUNT(*) AS total_items,
  COUNT(*) FILTER (WHERE order_delivered_carrier_date < order_approved_at) AS carrier_before_approval
FROM dispatched""",
    "j2_10_action_list": """
SELECT seller_id, q2_total_items, q2_breaches, q2_direct_customer_delays FROM seller_quarters
WHERE q2_total_items >= 10 AND q2_direct_customer_delays >= 3""",
    "j3_1_freight_vs_gmv": f"""
SELECT purchase_quarter, COUNT(DISTINCT order_id) AS total_orders, COUNT(*) AS total_items,
  {dbl('SUM(price)')} AS total_gmv, {dbl('SUM(freight_value)')} AS total_freight,
  {pct('SUM(freight_value)', 'SUM(price)')} AS freight_to_gmv_pct
FROM sold GROUP BY ALL""",
    "j3_2_freight_ge_price": f"""
SELECT purchase_quarter, COUNT(*) AS total_items, {_TOXIC} AS toxic_freight_items,
  {pct(_TOXIC, 'COUNT(*)')} AS toxic_item_pct
FROM sold GROUP BY ALL""",
    "j3_3_interstate_split": f"""
SELECT purchase_quarter, COUNT(*) AS total_delivered_items,
  COUNT(*) FILTER (WHERE shipping_type = 'Interstate') AS interstate_item_count,
  {pct("COUNT(*) FILTER (WHERE shipping_type = 'Interstate')", 'COUNT(*)')} AS interstate_item_pct
FROM routes GROUP BY ALL""",
    "j3_4_freight_gap": f"SELECT purchase_quarter, shipping_type, {_FREIGHT} FROM routes GROUP BY ALL",
    "j3_5_toxic_freight_split": f"""
SELECT purchase_quarter, shipping_type, COUNT(*) AS total_items, {_TOXIC} AS toxic_item,
  {pct(_TOXIC, 'COUNT(*)')} AS toxic_item_pct, {dbl(_TOXIC_FREIGHT)} AS total_toxic_freight_value,
  {per('SUM(freight_value) FILTER (WHERE toxic)', _TOXIC)} AS avg_toxic_freight
FROM routes GROUP BY ALL""",
    "j3_6_top_corridors": f"""
SELECT seller_state, customer_state, {_FREIGHT} FROM routes WHERE shipping_type = 'Interstate'
GROUP BY ALL HAVING COUNT(*) >= 20 ORDER BY SUM(freight_value) DESC, seller_state, customer_state LIMIT 10""",
    "j3_7_local_purchase_share": f"""
SELECT customer_state, COUNT(*) AS total_items,
  COUNT(*) FILTER (WHERE seller_state = customer_state) AS local_items,
  {pct("COUNT(*) FILTER (WHERE seller_state = customer_state)", 'COUNT(*)')} AS local_item_pct,
  {pct('SUM(freight_value)', 'SUM(price)')} AS freight_to_gmv_pct
FROM routes GROUP BY ALL""",
    "j3_8_who_pays_freight": f"""
SELECT COUNT(*) AS total_orders,
  {big('SUM(CASE WHEN ABS(paid - price - freight) < 0.05 THEN 1 ELSE 0 END)')} AS matched_orders,
  {pct('SUM(CASE WHEN ABS(paid - price - freight) < 0.05 THEN 1 ELSE 0 END)', 'COUNT(*)')} AS matched_pct,
  {dbl('SUM(price)')} AS total_price, {dbl('SUM(freight)')} AS total_freight, {dbl('SUM(paid)')} AS total_paid
FROM (SELECT order_id, SUM(price) AS price, SUM(freight_value) AS freight FROM sold GROUP BY order_id)
  JOIN (SELECT order_id, SUM(payment_value) AS paid FROM f_payments GROUP BY order_id) USING (order_id)""",
    "j4_1_payment_breakdown": f"""
SELECT payment_type, COUNT(DISTINCT order_id) AS total_orders, {dbl('SUM(payment_value)')} AS total_paid,
  {per('SUM(payment_value)', 'COUNT(DISTINCT order_id)')} AS avg_paid_per_order,
  {pct('SUM(payment_value)', 'SUM(SUM(payment_value)) OVER ()')} AS paid_share_pct
FROM half_year JOIN f_payments USING (order_id)
WHERE delivered AND payment_type <> 'not_defined' GROUP BY payment_type""",
    "j4_2_approval_latency": f"""
SELECT payment_type, COUNT(*) AS total_orders, {cents(f'AVG({_MINUTES}) / 60')} AS avg_approval_hours,
  {cents(f'AVG({_MINUTES}) / 60 / 24')} AS avg_approval_days,
  {pct(f'COUNT(*) FILTER (WHERE {_MINUTES} > 1440)', 'COUNT(*)')} AS over_24h_pct
FROM half_year JOIN (SELECT DISTINCT order_id, payment_type FROM f_payments) USING (order_id)
WHERE delivered AND order_approved_at IS NOT NULL GROUP BY payment_type""",
    "j4_3_order_loss": f"""
SELECT payment_type, COUNT(*) AS total_orders,
  COUNT(*) FILTER (WHERE order_status IN ('canceled', 'unavailable')) AS lost_orders,
  {pct("COUNT(*) FILTER (WHERE order_status IN ('canceled', 'unavailable'))", 'COUNT(*)')} AS lost_pct
FROM half_year JOIN (SELECT DISTINCT order_id, payment_type FROM f_payments) USING (order_id)
WHERE payment_type <> 'not_defined' GROUP BY payment_type""",
    "j4_4_customer_frequency": f"""
SELECT {_SEGMENT} AS customer_loyalty_segment, COUNT(customer_unique_id) AS total_unique_customers,
  {pct('COUNT(customer_unique_id)', 'SUM(COUNT(customer_unique_id)) OVER ()')} AS customer_share_pct
FROM (SELECT customer_unique_id, COUNT(DISTINCT order_id) AS n
      FROM o JOIN f_customers USING (customer_id) WHERE delivered GROUP BY ALL) GROUP BY {_SEGMENT}""",
    "j4_5_cohort_revenue": f"""
SELECT {_SEGMENT} AS customer_loyalty_segment, COUNT(customer_unique_id) AS total_customers, {dbl('SUM(spend)')} AS total_paid,
  {pct('SUM(spend)', 'SUM(SUM(spend)) OVER ()')} AS paid_share_pct,
  {per('SUM(spend)', 'SUM(n)')} AS avg_paid_per_order, {per('SUM(spend)', 'COUNT(spend)')} AS avg_paid_per_customer
FROM (SELECT customer_unique_id, COUNT(DISTINCT order_id) AS n, SUM(payment_value) AS spend
      FROM o JOIN f_customers USING (customer_id) JOIN f_payments USING (order_id)
      WHERE delivered GROUP BY customer_unique_id) GROUP BY {_SEGMENT}""",
    "j4_6_repeat_by_first_payment": f"""
SELECT payment_type AS first_order_payment, {_REPEAT}
FROM history JOIN main_payment USING (order_id) WHERE order_no = 1 GROUP BY ALL""",
    "j5_1_category_sales": f"""
WITH c AS (SELECT category_name, COUNT(*) AS n, COUNT(price) AS priced, SUM(price) AS gmv
           FROM sold JOIN labels_of USING (product_id) GROUP BY ALL)
SELECT DENSE_RANK() OVER (ORDER BY gmv DESC) AS revenue_rank, category_name, n AS total_item_sold,
  {dbl('gmv')} AS "total_GMV", {per('gmv', 'priced')} AS avg_item_price,
  {per('SUM(gmv) OVER ()', 'SUM(n) OVER ()')} AS overall_avg_item_price,
  {pct('gmv', 'SUM(gmv) OVER ()')} AS "GMV_share_pct",
  {pct('SUM(gmv) OVER (ORDER BY gmv DESC)', 'SUM(gmv) OVER ()')} AS "cumulative_top_GMV_Share_pct"
FROM c""",
    "j5_2_repeat_by_first_category": f"""
SELECT category_name AS first_order_category, {_REPEAT} FROM category_starts GROUP BY ALL
HAVING COUNT(*) >= 100""",
    "j5_2b_repeat_six_months": f"""
SELECT category_name AS first_order_category, {_REPEAT} FROM category_starts
WHERE order_purchase_timestamp < TIMESTAMP '1998-03-01' GROUP BY ALL HAVING COUNT(*) >= 100""",
    "j5_3a_one_star_on_time": f"""
SELECT category_name, COUNT(*) AS total_reviews, {cents('AVG(score)')} AS avg_review,
  COUNT(*) FILTER (WHERE score = 1) AS one_star_count,
  {pct('COUNT(*) FILTER (WHERE score = 1)', 'COUNT(*)')} AS one_star_pct
FROM punctual_reviews GROUP BY ALL HAVING COUNT(*) >= 100""",
    "j5_3b_multi_category_orders": f"""
SELECT COUNT(*) AS total_orders, {big('SUM(CASE WHEN n > 1 THEN 1 ELSE 0 END)')} AS multi_category_orders,
  {pct('SUM(CASE WHEN n > 1 THEN 1 ELSE 0 END)', 'COUNT(*)')} AS multi_category_pct
FROM (SELECT order_id, COUNT(DISTINCT category_name) AS n
      FROM sold JOIN labels_of USING (product_id) GROUP BY order_id)""",
    "j5_4_freight_by_category": f"""
SELECT category_name, COUNT(*) AS total_items_sold, {dbl('SUM(price)')} AS total_price,
  {dbl('SUM(freight_value)')} AS total_freight_value, {per('SUM(price)', 'COUNT(price)')} AS avg_price,
  {per('SUM(freight_value)', 'COUNT(freight_value)')} AS avg_freight_value,
  {cents('AVG(product_weight_g) / 1000')} AS avg_weight_kg,
  {cents('AVG(product_length_cm * product_height_cm * product_width_cm) / 1000')} AS avg_vol_liters,
  {pct('SUM(freight_value)', 'SUM(price)')} AS freight_to_gmv_pct
FROM sold JOIN labels_of USING (product_id) GROUP BY ALL HAVING COUNT(*) >= 100""",
    "j5_5_category_scorecard": f"""
WITH money AS (
  SELECT category_name, GROUPING(category_name) AS g,
    {pct('SUM(price)', '(SELECT SUM(price) FROM sold JOIN f_products USING (product_id))')} AS gmv_share_pct,
    {per('SUM(price)', 'COUNT(price)')} AS avg_item_price, {pct('SUM(freight_value)', 'SUM(price)')} AS freight_to_gmv_pct
  FROM sold JOIN labels_of USING (product_id) GROUP BY ROLLUP (category_name)),
back AS (SELECT category_name, GROUPING(category_name) AS g, {pct(_CAME_BACK, 'COUNT(*)')} AS came_back_pct
  FROM category_starts GROUP BY ROLLUP (category_name)),
stars AS (SELECT category_name, GROUPING(category_name) AS g,
    {pct('COUNT(*) FILTER (WHERE score = 1)', 'COUNT(*)')} AS one_star_pct
  FROM punctual_reviews GROUP BY ROLLUP (category_name))
SELECT CASE WHEN m.g = 1 THEN 'ALL CATEGORIES' ELSE m.category_name END AS category_name, gmv_share_pct,
  avg_item_price, came_back_pct, one_star_pct, freight_to_gmv_pct
FROM money m
  LEFT JOIN back b ON b.category_name IS NOT DISTINCT FROM m.category_name AND b.g = m.g
  LEFT JOIN stars s ON s.category_name IS NOT DISTINCT FROM m.category_name AND s.g = m.g
WHERE m.g = 1 OR m.category_name IN ('brand_1', 'brand_2', 'Brand#3', 'brand_5', 'unlabeled')""",
    "v1_one_review": f"SELECT order_id, {dbl('score')} AS review_score FROM scores",
    "v2_seller_quarters": "SELECT * FROM seller_quarters",
    "v3_clean_delivered_items": f"""
SELECT order_id, order_item_id, product_id, {dbl('price')} AS price, category_name
FROM sold JOIN labels_of USING (product_id)""",
    "v4_customer_orders": "SELECT * FROM history",
    "v5_main_payment": f"""
SELECT order_id, payment_type, {dbl('payment_value')} AS payment_value FROM main_payment""",
    "v6_main_category": f"SELECT order_id, category_name, {dbl('price')} AS price FROM main_category",
}

ORACLE_SQL: dict[str, str] = {**{name: with_fixture(sql) for name, sql in JOB_SQL.items()}, **OPERATOR_SQL}
