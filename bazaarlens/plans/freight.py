"""Who pays the freight, and on which routes? Amounts come from order totals or the corridor table."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import rules
from bazaarlens.functions.metrics import amount, mean_amount, pct, per_100
from bazaarlens.operators.grain import conditional_metrics, min_support
from bazaarlens.operators.ranking import in_order, top_n
from bazaarlens.operators.reconcile import reconcile_totals
from bazaarlens.plans.datasets import Datasets


def _crosses_border() -> Column:
    return F.col("seller_state") != F.col("customer_state")


def _is_local() -> Column:
    return F.col("seller_state") == F.col("customer_state")


def _shipping_type() -> Column:
    return F.when(_crosses_border(), F.lit(rules.INTERSTATE)).otherwise(F.lit(rules.LOCAL))


def _items_where(condition: Column) -> Column:
    """Items of the corridor rows where the condition holds."""
    return F.sum(F.when(condition, F.col("items")).otherwise(F.lit(0)))


def freight_vs_gmv(d: Datasets) -> DataFrame:
    """Orders are counted as distinct ids; an order listed twice counts its items twice."""
    price, freight = F.sum("price_cents"), F.sum("freight_cents")
    sums = {name: F.sum(name) for name in ("items", "price_cents", "freight_cents")}
    per_order = conditional_metrics(d.delivered_totals(), [d.purchase_quarter, "order_id"], sums)
    return conditional_metrics(
        per_order,
        ["purchase_quarter"],
        {
            "total_orders": F.count("order_id"),
            "total_items": F.sum("items"),
            "total_gmv": amount(price),
            "total_freight": amount(freight),
            "freight_to_gmv_pct": per_100(freight, price),
        },
    ).transform(in_order, "purchase_quarter")


def freight_ge_price(d: Datasets) -> DataFrame:
    items, toxic = F.sum("items"), F.sum("toxic_items")
    return conditional_metrics(
        d.delivered_totals(),
        [d.purchase_quarter],
        {"total_items": items, "toxic_freight_items": toxic, "toxic_item_pct": pct(toxic, items)},
    ).transform(in_order, "purchase_quarter")


def interstate_split(d: Datasets) -> DataFrame:
    items, interstate = F.sum("items"), _items_where(_crosses_border())
    return conditional_metrics(
        d.corridors,
        ["purchase_quarter"],
        {
            "total_delivered_items": items,
            "interstate_item_count": interstate,
            "interstate_item_pct": pct(interstate, items),
        },
    ).transform(in_order, "purchase_quarter")


def _freight_metrics() -> dict[str, Column]:
    items, price, freight = F.sum("items"), F.sum("price_cents"), F.sum("freight_cents")
    return {
        "total_items": items,
        "total_freight_value": amount(freight),
        "avg_freight_value": mean_amount(freight, F.sum("freighted")),
        "freight_to_gmv_pct": per_100(freight, price),
    }


def freight_gap(d: Datasets) -> DataFrame:
    keys = ["purchase_quarter", _shipping_type().alias("shipping_type")]
    return conditional_metrics(d.corridors, keys, _freight_metrics()).transform(
        in_order, "purchase_quarter", "shipping_type"
    )


def toxic_freight_split(d: Datasets) -> DataFrame:
    """Items whose freight reaches their price: their freight adds up to 0 where there are none, while its
    mean is then NULL."""
    items, toxic, freight = F.sum("items"), F.sum("toxic_items"), F.sum("toxic_freight_cents")
    return conditional_metrics(
        d.corridors,
        ["purchase_quarter", _shipping_type().alias("shipping_type")],
        {
            "total_items": items,
            "toxic_item": toxic,
            "toxic_item_pct": pct(toxic, items),
            "total_toxic_freight_value": amount(freight),
            "avg_toxic_freight": mean_amount(freight, toxic),
        },
    ).transform(in_order, "purchase_quarter", "shipping_type")


def top_corridors(d: Datasets) -> DataFrame:
    routes = conditional_metrics(
        d.corridors.filter(_crosses_border()), ["seller_state", "customer_state"], _freight_metrics()
    )
    order = [F.desc("total_freight_value"), F.asc("seller_state"), F.asc("customer_state")]
    return top_n(min_support(routes, "total_items", d.params.min_corridor_items), order, d.params.top_n)


def local_purchase_share(d: Datasets) -> DataFrame:
    items, local = F.sum("items"), _items_where(_is_local())
    return conditional_metrics(
        d.corridors,
        ["customer_state"],
        {
            "total_items": items,
            "local_items": local,
            "local_item_pct": pct(local, items),
            "freight_to_gmv_pct": per_100(F.sum("freight_cents"), F.sum("price_cents")),
        },
    ).transform(in_order, "local_item_pct", F.desc("total_items"), "customer_state")


def who_pays_freight(d: Datasets) -> DataFrame:
    """Orders whose payments equal price plus freight. Either side is one row per order before they meet."""
    charged = conditional_metrics(
        d.delivered_totals(),
        ["order_id"],
        {"total_price": F.sum("price_cents"), "total_freight": F.sum("freight_cents")},
    )
    paid = d.payment_totals(d.params.whole).select("order_id", F.col("paid_cents").alias("total_paid"))
    due = F.col("total_price") + F.col("total_freight")
    within_cents = ceil(d.params.match_tolerance * 100)
    matched = reconcile_totals(charged, paid, "order_id", due, F.col("total_paid"), within_cents)
    amounts = ("total_price", "total_freight", "total_paid")
    return matched.select(
        "total_orders", "matched_orders", "matched_pct", *(amount(F.col(name)).alias(name) for name in amounts)
    )
