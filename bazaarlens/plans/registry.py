"""Every analysis by name, in the order of the study's five parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from bazaarlens.plans import categories, delivery, freight, payments, sellers
from bazaarlens.plans.datasets import Datasets

JOBS: dict[str, Callable[[Datasets], DataFrame]] = {
    "j1_1a_late_rate_by_quarter": delivery.late_rate_by_quarter,
    "j1_1b_promised_vs_actual": delivery.promised_vs_actual,
    "j1_2a_leg_durations": delivery.leg_durations,
    "j1_2b_leg_durations_by_lateness": delivery.leg_durations_by_lateness,
    "j1_3_review_by_lateness": delivery.review_by_lateness,
    "j1_4_regional_performance": delivery.regional_performance,
    "j1_5a_status_review_audit": delivery.status_review_audit,
    "j1_5b_non_delivered_drag": delivery.non_delivered_drag,
    "j1_6_review_intake_by_quarter": delivery.review_intake_by_quarter,
    "j1_7_review_intake_by_month": delivery.review_intake_by_month,
    "j1_8_late_rate_by_delivery_month": delivery.late_rate_by_delivery_month,
    "j2_1_dispatch_baseline": sellers.dispatch_baseline,
    "j2_2_fulfillment_matrix": sellers.fulfillment_matrix,
    "j2_3_top_offenders": sellers.top_offenders,
    "j2_4_top_breachers": sellers.top_breachers,
    "j2_5_seller_quarters_filtered": sellers.seller_quarters_filtered,
    "j2_6_seller_segments": sellers.seller_segments,
    "j2_7_review_by_bucket": sellers.review_by_bucket,
    "j2_8_review_by_seller_group": sellers.review_by_seller_group,
    "j2_9_dq_carrier_before_approval": sellers.dq_carrier_before_approval,
    "j2_10_action_list": sellers.action_list,
    "j3_1_freight_vs_gmv": freight.freight_vs_gmv,
    "j3_2_freight_ge_price": freight.freight_ge_price,
    "j3_3_interstate_split": freight.interstate_split,
    "j3_4_freight_gap": freight.freight_gap,
    "j3_5_toxic_freight_split": freight.toxic_freight_split,
    "j3_6_top_corridors": freight.top_corridors,
    "j3_7_local_purchase_share": freight.local_purchase_share,
    "j3_8_who_pays_freight": freight.who_pays_freight,
    "j4_1_payment_breakdown": payments.payment_breakdown,
    "j4_2_approval_latency": payments.approval_latency,
    "j4_3_order_loss": payments.order_loss,
    "j4_4_customer_frequency": payments.customer_frequency,
    "j4_5_cohort_revenue": payments.cohort_revenue,
    "j4_6_repeat_by_first_payment": payments.repeat_by_first_payment,
    "j5_1_category_sales": categories.category_sales,
    "j5_2_repeat_by_first_category": categories.repeat_by_first_category,
    "j5_2b_repeat_six_months": categories.repeat_six_months,
    "j5_3a_one_star_on_time": categories.one_star_on_time,
    "j5_3b_multi_category_orders": categories.multi_category_orders,
    "j5_4_freight_by_category": categories.freight_by_category,
    "j5_5_category_scorecard": categories.category_scorecard,
}

# Views and intermediate tables the analyses are built on.
DATASETS: dict[str, Callable[[Datasets], DataFrame]] = {
    "v1_one_review": lambda d: d.one_review,
    "v2_seller_quarters": lambda d: d.seller_quarters,
    "v3_clean_delivered_items": lambda d: d.clean_delivered_items(),
    "v4_customer_orders": lambda d: d.customer_orders,
    "v5_main_payment": lambda d: d.main_payment,
    "v6_main_category": lambda d: d.main_category,
}
