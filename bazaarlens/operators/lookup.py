"""Adding what dimension tables know, after the large side has been added up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.rules import category_name
from bazaarlens.operators.grain import conditional_metrics


def corridor(
    orders: DataFrame,
    customers: DataFrame,
    items: DataFrame,
    sellers: DataFrame,
    keys: Sequence[str],
    totals: Mapping[str, Column],
) -> DataFrame:
    """Totals per key (columns of ``orders``), seller state and customer state.

    Orders meet their customer first (one row on either side), then their items. Items are added up per
    seller before sellers are looked up, so a seller with a third of all items is a few rows by then. The
    totals must be counts or sums, as they are added up twice.
    """
    placed = orders.select("order_id", "customer_id", *keys).join(
        customers.select("customer_id", "customer_state"), "customer_id"
    )
    by_seller = conditional_metrics(placed.join(items, "order_id"), [*keys, "seller_id", "customer_state"], totals)
    return conditional_metrics(
        by_seller.join(sellers.select("seller_id", "seller_state"), "seller_id"),
        [*keys, "seller_state", "customer_state"],
        {name: F.sum(name) for name in totals},
    )


def category_label(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Products with their English category, else the raw one, else a fixed word.

    Labels are looked up per product, not per item, and the word list need not hold every category.
    """
    translated = products.join(translation, "product_category_name", "left")
    return translated.withColumn("category_name", category_name()).drop("product_category_name_english")
