"""How customers pay, and whether they come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import rules
from bazaarlens.functions.metrics import amount, count_where, mean_amount, pct, ratio
from bazaarlens.operators.cohort import cohort_repeat, started_with
from bazaarlens.operators.grain import conditional_metrics, distinct_pairs
from bazaarlens.operators.ranking import in_order, share_of_total
from bazaarlens.plans.datasets import Datasets


def _defined() -> Column:
    return F.col("payment_type") != rules.UNDEFINED_PAYMENT


def payment_breakdown(d: Datasets) -> DataFrame:
    """Orders and money per payment type. One row per order id and type, so orders are counted once."""
    paid, orders = F.sum("paid_cents"), F.count("order_id")
    paid_by = d.delivered_orders().select("order_id").join(d.order_payment_types.filter(_defined()), "order_id")
    types = conditional_metrics(
        conditional_metrics(paid_by, ["order_id", "payment_type"], {"paid_cents": paid}),
        ["payment_type"],
        {
            "total_orders": orders,
            "total_paid": amount(paid),
            "avg_paid_per_order": mean_amount(paid, orders),
        },
    )
    return share_of_total(types, "total_paid", "paid_share_pct").transform(
        in_order, F.desc("total_paid"), "payment_type"
    )


def approval_latency(d: Datasets) -> DataFrame:
    """Time from purchase to approval per payment type; every type counts, also the undefined one."""
    minutes = F.col("minutes")
    waiting = (
        d.delivered_orders()
        .filter(F.col("order_approved_at").isNotNull())
        .select("order_id", rules.approval_minutes().alias("minutes"))
    )
    total, orders = F.sum(minutes), F.count("order_id")

    def mean_in(unit: int) -> Column:
        return ratio(total.cast("decimal(28,4)"), F.count(minutes).cast("decimal(20,0)") * unit)

    return conditional_metrics(
        waiting.join(distinct_pairs(d.order_payment_types, "order_id", "payment_type"), "order_id"),
        ["payment_type"],
        {
            "total_orders": orders,
            "avg_approval_hours": mean_in(60),
            "avg_approval_days": mean_in(60 * 24),
            "over_24h_pct": pct(count_where(minutes > d.params.slow_approval_minutes), orders),
        },
    ).transform(in_order, F.desc("avg_approval_hours"), "payment_type")


def order_loss(d: Datasets) -> DataFrame:
    """Canceled or unavailable orders per payment type."""
    lost, orders = count_where(F.col("lost")), F.count("order_id")
    types = distinct_pairs(d.order_payment_types.filter(_defined()), "order_id", "payment_type")
    return conditional_metrics(
        d.orders_in().select("order_id", rules.is_lost().alias("lost")).join(types, "order_id"),
        ["payment_type"],
        {"total_orders": orders, "lost_orders": lost, "lost_pct": pct(lost, orders)},
    ).transform(in_order, F.desc("total_orders"), "payment_type")


_SEGMENT = "customer_loyalty_segment"


def customer_frequency(d: Datasets) -> DataFrame:
    segment = rules.loyalty_segment(F.col("total_orders")).alias(_SEGMENT)
    segments = conditional_metrics(
        d.orders_per_person(), [segment], {"total_unique_customers": F.count("customer_unique_id")}
    )
    return share_of_total(segments, "total_unique_customers", "customer_share_pct").transform(in_order, _SEGMENT)


def cohort_revenue(d: Datasets) -> DataFrame:
    """Money per loyalty segment: per order, then per person, then per segment. Unpaid orders leave."""
    people = d.tables.customers.select("customer_id", "customer_unique_id")
    paid_orders = (
        d.tables.orders.filter(rules.is_delivered())
        .select("order_id", "customer_id")
        .join(d.payment_totals(), "order_id")
        .join(people, "customer_id")
    )
    per_order = conditional_metrics(
        paid_orders, ["customer_unique_id", "order_id"], {"paid_cents": F.sum("paid_cents")}
    )
    per_person = conditional_metrics(
        per_order,
        ["customer_unique_id"],
        {"total_orders": F.count("order_id"), "spend": F.sum("paid_cents")},
    )
    spend, customers = F.sum("spend"), F.count("customer_unique_id")
    segments = conditional_metrics(
        per_person,
        [rules.loyalty_segment(F.col("total_orders")).alias(_SEGMENT)],
        {
            "total_customers": customers,
            "total_paid": amount(spend),
            "avg_paid_per_order": mean_amount(spend, F.sum("total_orders")),
            "avg_paid_per_customer": mean_amount(spend, F.count("spend")),
        },
    )
    return (
        share_of_total(segments, "total_paid", "paid_share_pct")
        .select(
            _SEGMENT,
            "total_customers",
            "total_paid",
            "paid_share_pct",
            "avg_paid_per_order",
            "avg_paid_per_customer",
        )
        .transform(in_order, _SEGMENT)
    )


def repeat_by_first_payment(d: Datasets) -> DataFrame:
    started = started_with(d.first_orders, d.main_payment_by_key, key=d.order_ref)
    return cohort_repeat(started, "payment_type", "first_order_payment").transform(
        in_order, F.desc("total_customers"), "first_order_payment"
    )
