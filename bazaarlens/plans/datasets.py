"""Datasets several analyses share.

By default each is just a plan, built into every job that uses it. A run of many jobs passes ``keep`` (see
:func:`stored`) so that each is computed once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cached_property
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import rules
from bazaarlens.functions.metrics import cents, count_where, sum_where
from bazaarlens.functions.periods import dated_within, facts_around, period_bucket, purchased_within, within
from bazaarlens.marketplace import Marketplace
from bazaarlens.operators.grain import (
    conditional_metrics,
    distinct_count,
    first_record_with_total,
    main_record,
    numbered_records,
)
from bazaarlens.operators.lookup import category_label, corridor
from bazaarlens.params import Params, Period
from bazaarlens.schemas import DATED_TABLES, ORDER_KEY
from bazaarlens.session import shared_dir
from bazaarlens.sources.labels import ITEM_LABEL


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the rows to a table in the folder (the cluster's shared checkpoint folder) and go on from there.

    Later jobs then read the files, and only the columns they need, also after executors were lost.
    """
    path = f"{folder or shared_dir(df.sparkSession)}/stored-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _listed(facts: DataFrame, key: str) -> DataFrame:
    """Without the rows of unknown orders, which have no number and would else be one group."""
    return facts.filter(F.col(key).isNotNull()) if key == ORDER_KEY else facts


class Datasets:
    """Views over the marketplace tables, with the study's parameters."""

    def __init__(
        self,
        tables: Marketplace,
        params: Params | None = None,
        keep: Callable[[DataFrame], DataFrame] | None = None,
    ) -> None:
        self.tables = tables
        self.params = params or Params()
        self._sharing = keep is not None
        self._keep = keep or (lambda df: df)

    # --- Orders -------------------------------------------------------------------------------------

    @property
    def purchase_quarter(self) -> Column:
        return period_bucket(F.col("order_purchase_timestamp"), self.params.periods).alias("purchase_quarter")

    def orders_in(self, period: Period | None = None) -> DataFrame:
        """Orders of any status bought in the period (both quarters unless one is named)."""
        return self.tables.orders.filter(purchased_within(self.tables.orders, period or self.params.whole))

    def delivered_orders(self, period: Period | None = None) -> DataFrame:
        return self.orders_in(period).filter(rules.is_delivered())

    def dated(self, table: str, period: Period | None = None) -> DataFrame:
        """Orders or reviews whose own date (delivery, creation) is in the period, from the layout by that date if
        there is one."""
        _, at, month = DATED_TABLES[table]
        find = getattr(self.tables, "by_own_date", None)
        rows = find(table) if find else None
        if rows is None:
            return getattr(self.tables, table).filter(within(F.col(at), period or self.params.whole))
        return dated_within(rows, at, month, period or self.params.whole)

    # --- Reviews ------------------------------------------------------------------------------------

    def _score_per_order(self, reviews: DataFrame) -> DataFrame:
        total, n = F.sum("review_score").cast("decimal(18,4)"), F.count("review_score").cast("decimal(18,0)")
        return conditional_metrics(reviews, ["order_id"], {"review_score": F.try_divide(total, n).cast("decimal(8,4)")})

    @property
    def one_review(self) -> DataFrame:
        """One score per order: the mean, to 4 decimals, where an order was reviewed more than once."""
        return self._score_per_order(self.tables.order_reviews)

    @cached_property
    def order_scores(self) -> DataFrame:
        """The same for orders of both quarters (and others, where reviews are not stored by month)."""
        return self._keep(self._score_per_order(facts_around(self.tables.order_reviews, self.params.whole)))

    # --- Items with their order ---------------------------------------------------------------------

    def items_around(self, period: Period | None = None) -> DataFrame:
        """Items to be joined to orders of the period, which bring the order's number."""
        return facts_around(self.tables.order_items, period or self.params.whole).drop(ORDER_KEY)

    def delivered_items(self, period: Period | None = None) -> DataFrame:
        """Items of delivered orders with their order.

        Items meet orders straight from their shuffles and are aggregated by other keys next, so adaptive
        execution can split an order with very many items. A run that shares datasets joins them once.
        """
        if self._sharing:
            items = self._shared_items
            return items if period is None else items.filter(purchased_within(items, period))
        return self.delivered_orders(period).join(self.items_around(period), "order_id")

    @cached_property
    def _shared_items(self) -> DataFrame:
        return self._keep(self.delivered_orders().join(self.items_around(), "order_id"))

    def dispatched_items(self, period: Period | None = None) -> DataFrame:
        """Items of delivered orders that have a carrier handover, with the order's times."""
        return self.delivered_items(period).filter(F.col("order_delivered_carrier_date").isNotNull())

    def reviewed_items(
        self,
        item_columns: Sequence[str],
        period: Period | None = None,
        how: str = "inner",
        totals: Mapping[str, Column] | None = None,
    ) -> DataFrame:
        """Items of delivered orders, alike ones as one row, with their order and its score.

        ``n_rows`` and ``n_items`` say how many rows, and how many with an item number, a row stands for. Items
        are reduced before they meet their order, so a hot order brings one row per task for each of its
        combinations. ``how="left"`` keeps orders without a score, and ``reviewed`` tells them apart; ``totals``
        are further sums over the rows.
        """
        scores = self.order_scores.withColumn("reviewed", F.lit(True))
        scored = self.delivered_orders(period).join(scores, "order_id", how)
        alike = conditional_metrics(
            self.items_around(period),
            ["order_id", *item_columns],
            {"n_rows": F.count(F.lit(1)), "n_items": F.count("order_item_id"), **(totals or {})},
        )
        return alike.join(scored, "order_id")

    @cached_property
    def seller_quarters(self) -> DataFrame:
        """Per seller: items and breaches in either quarter, and late doorsteps they caused in the later."""
        bought = F.col("order_purchase_timestamp")
        earlier, later = within(bought, self.params.earlier), within(bought, self.params.later)
        breach, harm = rules.is_breach(), rules.is_breach() & rules.is_late()
        return self._keep(
            conditional_metrics(
                self.dispatched_items(),
                ["seller_id"],
                {
                    # Names of published result columns.
                    "q1_total_items": count_where(earlier),
                    "q1_breaches": count_where(earlier & breach),
                    "q2_total_items": count_where(later),
                    "q2_breaches": count_where(later & breach),
                    "q2_direct_customer_delays": count_where(later & harm),
                },
            )
        )

    @cached_property
    def item_totals(self) -> DataFrame:
        """Per order, over all its items: number, price, freight, and items whose freight reaches the price.

        Items are added up before they meet their order, so an order of any size sends one row per task.
        """
        return self._keep(
            conditional_metrics(
                self.items_around(),
                ["order_id"],
                {
                    "items": F.count("order_item_id"),
                    "price_cents": F.sum(cents(F.col("price"))),
                    "freight_cents": F.sum(cents(F.col("freight_value"))),
                    "toxic_items": count_where(rules.freight_covers_price()),
                },
            )
        )

    def delivered_totals(self) -> DataFrame:
        """Item totals of the delivered orders in both quarters."""
        return self.delivered_orders().join(self.item_totals, "order_id")

    # --- Routes -------------------------------------------------------------------------------------

    @cached_property
    def corridors(self) -> DataFrame:
        """Per quarter, seller state and customer state: items, price, freight, and freight-heavy items."""
        heavy, freight = rules.freight_covers_price(), cents(F.col("freight_value"))
        return self._keep(
            corridor(
                self.delivered_orders().withColumn("purchase_quarter", self.purchase_quarter),
                self.tables.customers,
                self.items_around(),
                self.tables.sellers,
                ["purchase_quarter"],
                {
                    "items": F.count("order_item_id"),
                    "price_cents": F.sum(cents(F.col("price"))),
                    "freight_cents": F.sum(freight),
                    "freighted": F.count("freight_value"),
                    "toxic_items": count_where(heavy),
                    "toxic_freight_cents": sum_where(heavy, freight),
                },
            )
        )

    # --- Payments -----------------------------------------------------------------------------------

    @cached_property
    def order_payment_types(self) -> DataFrame:
        """One row per order and payment type, with the amount, for orders of both quarters."""
        return self._keep(
            conditional_metrics(
                facts_around(self.tables.order_payments, self.params.whole),
                ["order_id", "payment_type"],
                {"paid_cents": F.sum(cents(F.col("payment_value")))},
            )
        )

    def payment_totals(self, period: Period | None = None) -> DataFrame:
        """One row per order with all it paid; of the whole history unless a period is named."""
        payments = self.tables.order_payments
        return conditional_metrics(
            payments if period is None else facts_around(payments, period),
            ["order_id"],
            {"paid_cents": F.sum(cents(F.col("payment_value")))},
        )

    @cached_property
    def main_payment(self) -> DataFrame:
        """The payment type with the largest single payment of each order; equal ones by name."""
        return self._keep(self._main_payment("order_id"))

    @cached_property
    def main_payment_by_key(self) -> DataFrame:
        """The same by ``order_ref``, for orders that are listed."""
        return self.main_payment if self.order_ref == "order_id" else self._keep(self._main_payment(self.order_ref))

    def _main_payment(self, key: str) -> DataFrame:
        payments = self.tables.order_payments.select(key, "payment_type", "payment_value")
        order = [F.col("payment_value").desc(), F.col("payment_type").asc()]
        return main_record(_listed(payments, key), key, order)

    # --- People -------------------------------------------------------------------------------------

    @cached_property
    def order_ref(self) -> str:
        """The column by which orders of the whole history are told apart: their number where the tables have one."""
        tables = (self.tables.orders, self.tables.order_items, self.tables.order_payments)
        return ORDER_KEY if all(ORDER_KEY in table.columns for table in tables) else "order_id"

    def _purchases(self, key: str = "order_id") -> DataFrame:
        """Delivered orders of the whole history with the person who placed them."""
        people = self.tables.customers.select("customer_id", "customer_unique_id")
        return (
            self.tables.orders.filter(rules.is_delivered())
            .select(key, "customer_id", "order_purchase_timestamp")
            .join(people, "customer_id")
            .select("customer_unique_id", key, "order_purchase_timestamp")
        )

    @cached_property
    def customer_orders(self) -> DataFrame:
        """Every delivered order with its number in the person's history and the person's total."""
        return self._keep(
            numbered_records(
                self._purchases(), "customer_unique_id", "order_purchase_timestamp", "order_id"
            )
        )

    @cached_property
    def first_orders(self) -> DataFrame:
        """Each person's first delivered order, by ``order_ref``, and their number of orders."""
        purchases = self._purchases(self.order_ref)
        return self._keep(
            first_record_with_total(purchases, "customer_unique_id", "order_purchase_timestamp", self.order_ref)
        )

    def orders_per_person(self) -> DataFrame:
        """Orders per person, as distinct ids."""
        return distinct_count(self._purchases(), ["customer_unique_id"], "order_id", "total_orders")

    # --- Categories ---------------------------------------------------------------------------------

    @cached_property
    def product_categories(self) -> DataFrame:
        """Products with their category label."""
        return self._keep(category_label(self.tables.products, self.tables.category_translation))

    @property
    def category_key(self) -> str:
        """The items' column that leads to their category: the label where items carry it, else the product."""
        return ITEM_LABEL if ITEM_LABEL in self.tables.order_items.columns else "product_id"

    def with_category(self, items: DataFrame) -> DataFrame:
        """Rows with a known category, as ``category_name``."""
        if ITEM_LABEL in items.columns:
            return items.filter(F.col(ITEM_LABEL).isNotNull()).withColumnRenamed(ITEM_LABEL, "category_name")
        return items.join(self.product_categories.select("product_id", "category_name"), "product_id")

    def clean_delivered_items(self) -> DataFrame:
        """Items of delivered orders in both quarters with their category."""
        labeled = self.with_category(self.delivered_items())
        return labeled.select("order_id", "order_item_id", "product_id", "price", "category_name")

    @cached_property
    def main_category(self) -> DataFrame:
        """Category of the priciest item of each order, of any status and date; equal prices by item."""
        return self._keep(self._main_category("order_id"))

    @cached_property
    def main_category_by_key(self) -> DataFrame:
        """The same by ``order_ref``, for orders that are listed."""
        return self.main_category if self.order_ref == "order_id" else self._keep(self._main_category(self.order_ref))

    def _main_category(self, key: str) -> DataFrame:
        priced = self.with_category(self.tables.order_items).select(key, "order_item_id", "price", "category_name")
        order = [F.col("price").desc(), F.col("order_item_id").asc(), F.col("category_name").asc()]
        return main_record(_listed(priced, key), key, order).select(key, "category_name", "price")

    @cached_property
    def category_sales(self) -> DataFrame:
        """Per category, delivered orders in both quarters: items, price, freight, weight and volume.

        Items are added up per product before products are looked up: a best seller is one row by then,
        and its weight and volume count once per item sold.
        """
        by_product = conditional_metrics(
            self.delivered_items(),
            ["product_id"],
            {
                "sold": F.count("order_item_id"),
                "priced": F.count("price"),
                "freighted": F.count("freight_value"),
                "price_cents": F.sum(cents(F.col("price"))),
                "freight_cents": F.sum(cents(F.col("freight_value"))),
            },
        )
        weight = F.col("product_weight_g")
        volume = F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm")
        sold = F.col("sold")
        return self._keep(
            conditional_metrics(
                by_product.join(self.product_categories, "product_id"),
                ["category_name"],
                {
                    "items": F.sum(sold),
                    **{
                        name: F.sum(name)
                        for name in ("priced", "freighted", "price_cents", "freight_cents")
                    },
                    "weight_g": F.sum(weight * sold),
                    "weighed": F.sum(F.when(weight.isNotNull(), sold)),
                    "volume_cm3": F.sum(volume * sold),
                    "measured": F.sum(F.when(volume.isNotNull(), sold)),
                },
            )
        )
