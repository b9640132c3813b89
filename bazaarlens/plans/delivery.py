"""Was the delivery crisis real, and where was the time lost? One row per order unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import rules
from bazaarlens.functions.metrics import count_where, mean, pct
from bazaarlens.functions.periods import month_label, month_start, period_bucket
from bazaarlens.operators.grain import conditional_metrics
from bazaarlens.operators.ranking import in_order
from bazaarlens.plans.datasets import Datasets


def _known(*columns: str) -> Column:
    condition = F.col(columns[0]).isNotNull()
    for column in columns[1:]:
        condition = condition & F.col(column).isNotNull()
    return condition


def _orders() -> Column:
    return F.count("order_id")


def _late_pct() -> Column:
    return pct(count_where(rules.is_late()), _orders())


def _arrived(d: Datasets) -> DataFrame:
    """Delivered orders with both dates lateness needs."""
    return d.delivered_orders().filter(
        _known("order_delivered_customer_date", "order_estimated_delivery_date")
    )


def _timed(d: Datasets) -> DataFrame:
    """Delivered orders with every step dated and no handover on a day before the approval."""
    return (
        d.delivered_orders()
        .filter(_known("order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date"))
        .filter(rules.seller_days() >= 0)
    )


def late_rate_by_quarter(d: Datasets) -> DataFrame:
    return (
        conditional_metrics(
            _arrived(d),
            [d.purchase_quarter],
            {"total_delivered_orders": _orders(), "late_order_pct": _late_pct()},
        )
        .transform(in_order, "purchase_quarter")
    )


def promised_vs_actual(d: Datasets) -> DataFrame:
    bought = F.col("order_purchase_timestamp")
    return conditional_metrics(
        _arrived(d),
        [d.purchase_quarter],
        {
            "total_delivered_orders": _orders(),
            "avg_promised_days": mean(F.datediff("order_estimated_delivery_date", bought)),
            "avg_actual_days": mean(F.datediff("order_delivered_customer_date", bought)),
        },
    ).transform(in_order, "purchase_quarter")


_LEGS = {
    "total_delivered_orders": _orders,
    "avg_seller_days": lambda: mean(rules.seller_days()),
    "avg_carrier_days": lambda: mean(rules.carrier_days()),
}


def _legs() -> dict[str, Column]:
    return {name: metric() for name, metric in _LEGS.items()}


def leg_durations(d: Datasets) -> DataFrame:
    return conditional_metrics(_timed(d), [d.purchase_quarter], _legs()).transform(in_order, "purchase_quarter")


def leg_durations_by_lateness(d: Datasets) -> DataFrame:
    timed = _timed(d).filter(_known("order_estimated_delivery_date"))
    keys = [d.purchase_quarter, rules.delivery_status().alias("delivery_status")]
    return conditional_metrics(timed, keys, _legs()).transform(in_order, "purchase_quarter", "delivery_status")


def review_by_lateness(d: Datasets) -> DataFrame:
    keys = [d.purchase_quarter, rules.delivery_status().alias("delivery_status")]
    return conditional_metrics(
        _arrived(d).join(d.order_scores, "order_id"),
        keys,
        {"total_orders": _orders(), "avg_review_score": mean(F.col("review_score"))},
    ).transform(in_order, "purchase_quarter", "delivery_status")


def regional_performance(d: Datasets) -> DataFrame:
    states = d.tables.customers.select("customer_id", "customer_state")
    return conditional_metrics(
        _arrived(d).join(d.order_scores, "order_id").join(states, "customer_id"),
        ["customer_state", d.purchase_quarter],
        {
            "late_order_pct": _late_pct(),
            "total_orders": _orders(),
            "avg_review_score": mean(F.col("review_score")),
        },
    ).transform(in_order, "customer_state", "purchase_quarter")


def status_review_audit(d: Datasets) -> DataFrame:
    """Orders of every status; those without a review count, but not in the mean."""
    return conditional_metrics(
        d.orders_in().join(d.order_scores, "order_id", "left"),
        ["order_status", d.purchase_quarter],
        {"total_orders": _orders(), "avg_review_score": mean(F.col("review_score"))},
    ).transform(in_order, "purchase_quarter", F.desc("total_orders"), "order_status")


def non_delivered_drag(d: Datasets) -> DataFrame:
    """How far orders that never arrived pull the score; the difference is taken before rounding."""
    score = F.col("review_score")
    delivered_score = F.when(rules.is_delivered(), score)

    def unrounded(value: Column) -> Column:
        return F.try_divide(F.sum(value).cast("decimal(28,4)"), F.count(value).cast("decimal(20,0)"))

    drag = F.round(unrounded(score) - unrounded(delivered_score), 2).cast("decimal(20,2)")
    return conditional_metrics(
        d.orders_in().join(d.order_scores, "order_id", "left"),
        [d.purchase_quarter],
        {
            "reviewed_orders": F.count(score),
            "avg_score_all_orders": mean(score),
            "avg_score_delivered_only": mean(delivered_score),
            "score_drag": drag,
        },
    ).transform(in_order, "purchase_quarter")


def _reviews_received(d: Datasets) -> DataFrame:
    """Raw reviews by their own date, one row per review."""
    return d.dated("order_reviews")


def review_intake_by_quarter(d: Datasets) -> DataFrame:
    quarter = period_bucket(F.col("review_creation_date"), d.params.periods).alias("review_quarter")
    return conditional_metrics(
        _reviews_received(d),
        [quarter],
        {"total_reviews": F.count(F.lit(1)), "avg_review_score": mean(F.col("review_score"))},
    ).transform(in_order, "review_quarter")


def review_intake_by_month(d: Datasets) -> DataFrame:
    one_star, total = count_where(F.col("review_score") == 1), F.count(F.lit(1))
    return _label_month(
        conditional_metrics(
            _reviews_received(d),
            [month_start(F.col("review_creation_date")).alias("review_month")],
            {
                "total_reviews": total,
                "avg_review_score": mean(F.col("review_score")),
                "one_star_reviews": one_star,
                "one_star_pct": pct(one_star, total),
            },
        ),
        "review_month",
    )


def late_rate_by_delivery_month(d: Datasets) -> DataFrame:
    delivered = F.col("order_delivered_customer_date")
    arrived = d.dated("orders").filter(rules.is_delivered()).filter(_known("order_estimated_delivery_date"))
    return _label_month(
        conditional_metrics(
            arrived,
            [month_start(delivered).alias("delivery_month")],
            {"total_delivered_orders": _orders(), "late_order_pct": _late_pct()},
        ),
        "delivery_month",
    )


def _label_month(df: DataFrame, month: str) -> DataFrame:
    return df.withColumn(month, month_label(F.col(month))).transform(in_order, month)
