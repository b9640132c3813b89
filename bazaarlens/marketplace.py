"""The set of marketplace tables a job reads."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame


class Marketplace(Protocol):
    """Anything with one DataFrame per table.

    Grain and keys the jobs rely on: ``orders`` has one row per ``order_id``, ``customers`` one row per
    ``customer_id`` (a new one for every order; the person is ``customer_unique_id``), ``sellers`` one per
    ``seller_id``, ``products`` one per ``product_id``. ``order_items``, ``order_payments`` and
    ``order_reviews`` have several rows per order. Orders and these tables may carry the month or day of
    the purchase as well (see :mod:`bazaarlens.functions.periods`), used only to prune files.
    """

    orders: DataFrame
    order_items: DataFrame
    order_payments: DataFrame
    order_reviews: DataFrame
    customers: DataFrame
    sellers: DataFrame
    products: DataFrame
    category_translation: DataFrame
    geolocation: DataFrame | None
