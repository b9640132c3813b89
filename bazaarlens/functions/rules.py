"""Business rules on order, item, payment and review columns."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order states and the payment type that means "none chosen".
DELIVERED = "delivered"
LOST_STATES = ("canceled", "unavailable")
UNDEFINED_PAYMENT = "not_defined"

# Labels in the results.
DELAYED, ON_TIME = "delay", "on time"
CLEAN_DELIVERY = "01_clean_delivery"
CARRIER_RESCUE = "02_carrier_rescue"
CARRIER_DELAY = "03_carrier_delay"
SELLER_DELAY = "04_seller_delay"
UNCLASSIFIED = "unclassified"
INTERSTATE, LOCAL = "Interstate", "Local"
UNLABELED = "unlabeled"


def is_delivered() -> Column:
    return F.col("order_status") == DELIVERED


def is_lost() -> Column:
    """Canceled or unavailable. Orders still on their way are not lost."""
    return F.col("order_status").isin(*LOST_STATES)


def is_late() -> Column:
    """Delivered on a later *date* than estimated; the estimate is stored at midnight. NULL if either is."""
    return F.to_date("order_delivered_customer_date") > F.to_date("order_estimated_delivery_date")


def is_punctual() -> Column:
    """Delivered no later than the estimated date. NULL if either is, so not simply ``~is_late()``."""
    return F.to_date("order_delivered_customer_date") <= F.to_date("order_estimated_delivery_date")


def is_breach() -> Column:
    """Handed to the carrier after the item's own deadline; a deadline has a time, so times are compared."""
    return F.col("order_delivered_carrier_date") > F.col("shipping_limit_date")


def is_dispatched_on_time() -> Column:
    return F.col("order_delivered_carrier_date") <= F.col("shipping_limit_date")


def seller_days() -> Column:
    """Calendar days from approval to carrier handover."""
    return F.datediff("order_delivered_carrier_date", "order_approved_at")


def carrier_days() -> Column:
    """Calendar days from carrier handover to the door."""
    return F.datediff("order_delivered_customer_date", "order_delivered_carrier_date")


def approval_minutes() -> Column:
    """Whole elapsed minutes from purchase to approval."""
    return F.timestamp_diff("MINUTE", F.col("order_purchase_timestamp"), F.col("order_approved_at"))


def delivery_status() -> Column:
    return F.when(is_late(), F.lit(DELAYED)).otherwise(F.lit(ON_TIME))


def fulfillment_bucket() -> Column:
    """Seller punctual or not, crossed with customer served on time or not."""
    return (
        F.when(is_dispatched_on_time() & is_punctual(), F.lit(CLEAN_DELIVERY))
        .when(is_breach() & is_punctual(), F.lit(CARRIER_RESCUE))
        .when(is_dispatched_on_time() & is_late(), F.lit(CARRIER_DELAY))
        .when(is_breach() & is_late(), F.lit(SELLER_DELAY))
        .otherwise(F.lit(UNCLASSIFIED))
    )


def freight_covers_price() -> Column:
    """Freight as high as the item's price, or higher."""
    return F.col("freight_value") >= F.col("price")


def at_least_share(part: Column, whole: Column, share: Decimal) -> Column:
    """``part >= share * whole`` without floating point."""
    return part >= F.lit(share) * whole


def first_match(rules: Sequence[tuple[str, Column]], default: str) -> Column:
    """Label of the first rule that holds; a rule that is NULL does not hold."""
    (label, condition), *rest = rules
    chosen = F.when(condition, F.lit(label))
    for label, condition in rest:
        chosen = chosen.when(condition, F.lit(label))
    return chosen.otherwise(F.lit(default))


def loyalty_segment(orders: Column) -> Column:
    """Buyers by their number of orders."""
    return first_match(
        [  # Fixed values: segment labels.
            ("01_Single_Purchase_Buyer (1x)", orders == 1),
            ("02_Repeat_Purchase_Buyer (2x)", orders == 2),
        ],
        "03_Loyal_Customer (3x+)",
    )


def category_name() -> Column:
    """English label, else the raw one, else a fixed word for none."""
    return F.coalesce("product_category_name_english", "product_category_name", F.lit(UNLABELED))
