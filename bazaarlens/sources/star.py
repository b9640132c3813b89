"""Marketplace tables derived from a star schema of orders and line items.

Used for tests and benchmarks: every marketplace column is a fixed function of the star schema's keys, laid
out in FIXTURES.md, so that the data holds each case the metric rules are about.
"""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.functions.periods import moment
from bazaarlens.functions.rules import is_late
from bazaarlens.params import Params, Period

_REGIME_CHANGE = datetime(1998, 4, 1)

# Declared, so that no file is opened before a query runs.
STAR_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
}

# Periods inside the data, and thresholds that suit its volume.
STAR_PARAMS = Params(
    earlier=Period("1998-Q1", datetime(1998, 1, 1), datetime(1998, 4, 1)),
    later=Period("1998-Q2", datetime(1998, 4, 1), datetime(1998, 7, 1)),
    min_items=10,
    exit_items=3,
    follow_up_before=datetime(1998, 3, 1),
    scorecard_categories=("brand_1", "brand_2", "Brand#3", "brand_5", "unlabeled"),
)


def _after(ts: Column, minutes: Column) -> Column:
    return ts + minutes * F.expr("INTERVAL '1' MINUTE")


def _money(value: Column) -> Column:
    """Two-decimal amounts held as doubles, by way of whole cents: a direct cast goes through text."""
    whole = F.rint(value * 100).cast("bigint").cast("decimal(12,0)")
    return (whole * F.lit(Decimal("0.01"))).cast("decimal(12,2)")


def _unless(missing: Column, value: Column) -> Column:
    return F.when(~missing, value)


def _orders(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    purchase = _after(F.col("o_orderdate"), (key * 37) % 1440)
    handover, transit = (key * 61) % 9000, (key * 71) % 33120
    status = F.lit("delivered")
    for slot, lesser in enumerate(("canceled", "unavailable", "shipped", "invoiced", "processing")):
        status = F.when(key % 40 == slot, F.lit(lesser)).otherwise(status)
    return orders.select(
        key.alias("order_id"),
        key.alias("customer_id"),
        status.alias("order_status"),
        purchase.alias("order_purchase_timestamp"),
        _unless(key % 97 == 0, _after(purchase, (key * 53) % 2880)).alias("order_approved_at"),
        _unless(key % 89 == 0, _after(purchase, handover)).alias("order_delivered_carrier_date"),
        _unless((key % 40 < 5) | (key % 101 == 0), _after(purchase, handover + transit)).alias(
            "order_delivered_customer_date"
        ),
        _after(F.col("o_orderdate"), (key % 13 + 18) * 1440).alias("order_estimated_delivery_date"),
        F.col("o_orderdate").alias("purchase_day"),
        "o_custkey",
        "o_orderpriority",
    )


def _order_items(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    ordered = F.col("o_orderdate")
    later = ordered >= moment(_REGIME_CHANGE)
    # A seller who has stopped selling hands over to the fourth one after.
    seller = F.col("l_suppkey") + F.when((F.col("l_suppkey") % 20 == 3) & later, 4).otherwise(0)
    kind = seller % 4
    patient = (kind == 0) | ((kind == 1) & ~later) | ((kind == 2) & later)
    freight = F.when(F.col("l_partkey") % 40 == 9, F.lit(0.0)).otherwise(F.col("l_quantity") * 300)
    return (
        lineitem.join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            seller.alias("seller_id"),
            _after(ordered, F.when(patient, F.lit(9200)).otherwise(F.lit(4000))).alias("shipping_limit_date"),
            _money(F.col("l_extendedprice")).alias("price"),
            _money(freight).alias("freight_value"),
            ordered.alias("order_day"),
        )
    )


def _order_payments(orders: DataFrame, items: DataFrame) -> DataFrame:
    # The day follows from the order; as a second key, a filter on it reaches the items too.
    keys = ["order_id", "order_day"]
    due = items.groupBy(*keys).agg(F.sum(F.col("price") + F.col("freight_value")).alias("due"))
    orders = orders.withColumnRenamed("purchase_day", "order_day")
    key, priority, money = F.col("order_id"), F.col("o_orderpriority"), "decimal(14,2)"
    main_type = (
        F.when(key % 500 == 7, F.lit("not_defined"))
        .when(priority.isin("1-URGENT", "3-MEDIUM"), F.lit("credit_card"))
        .when(priority == "2-HIGH", F.lit("boleto"))
        .when(priority == "5-LOW", F.lit("debit_card"))
        .otherwise(F.lit("voucher"))
    )
    vouchers = F.when(key % 10 == 3, F.lit(Decimal(100))).otherwise(F.lit(Decimal(0)))
    surplus = F.when(key % 100 == 11, F.lit(Decimal(5))).otherwise(F.lit(Decimal(0)))

    def payment(number: int, kind: Column, amount: Column) -> Column:
        return F.struct(
            F.lit(number).alias("payment_sequential"),
            kind.alias("payment_type"),
            amount.cast(money).alias("payment_value"),
        )

    main = payment(1, main_type, F.col("due") - vouchers + surplus)
    split = [payment(number, F.lit("voucher"), F.lit(Decimal(50))) for number in (2, 3)]
    paid = F.when(key % 10 == 3, F.array(main, *split)).otherwise(F.array(main))
    return (
        orders.filter(key % 1000 != 13)
        .join(due, keys)
        .select(*keys, F.inline(paid).alias("payment_sequential", "payment_type", "payment_value"))
    )


def _order_reviews(orders: DataFrame) -> DataFrame:
    key = F.col("order_id")
    score = (
        F.when(key % 23 == 0, F.lit(1))
        .when(is_late(), key % 3 + 1)
        .otherwise(key % 3 + 3)
        .cast("int")
    )
    second = F.when(F.col("score") == 1, F.lit(2)).otherwise(6 - F.col("score"))
    scores = F.when(key % 50 == 5, F.array("score", second)).otherwise(F.array("score"))
    return (
        orders.filter(key % 60 != 7)
        .withColumn("score", score)
        .select(
            "order_id",
            F.explode(scores).alias("review_score"),
            F.to_date("order_estimated_delivery_date").cast("timestamp_ntz").alias("review_creation_date"),
            F.col("purchase_day").alias("order_day"),
        )
    )


def _products(part: DataFrame) -> DataFrame:
    bare = F.col("p_partkey") % 50 == 0
    return part.select(
        F.col("p_partkey").alias("product_id"),
        _unless(bare, F.col("p_brand")).alias("product_category_name"),
        _unless(bare, F.col("p_size") * 100).cast("double").alias("product_weight_g"),
        F.col("p_size").cast("double").alias("product_length_cm"),
        F.lit(10.0).alias("product_height_cm"),
        F.lit(20.0).alias("product_width_cm"),
    )


class StarMarketplace:
    """The marketplace tables over a folder of star-schema Parquet files, each planned when first asked for."""

    geolocation = None

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark = spark
        self._dir = sf_dir

    def _star(self, table: str) -> DataFrame:
        return self._spark.read.schema(STAR_SCHEMAS[table]).parquet(f"{self._dir}/{table}.parquet")

    def _places(self) -> DataFrame:
        regions = self._star("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
        return self._star("nation").join(regions, "n_regionkey").select("n_nationkey", "r_name")

    @cached_property
    def orders(self) -> DataFrame:
        return _orders(self._star("orders"))

    @cached_property
    def order_items(self) -> DataFrame:
        return _order_items(self._star("lineitem"), self._star("orders"))

    @cached_property
    def order_payments(self) -> DataFrame:
        return _order_payments(self.orders, self.order_items)

    @cached_property
    def order_reviews(self) -> DataFrame:
        return _order_reviews(self.orders)

    @cached_property
    def customers(self) -> DataFrame:
        person = F.col("o_custkey") * 17 + F.col("o_orderkey") % 17
        return (
            self._star("orders")
            .join(self._star("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self._places(), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("o_orderkey").alias("customer_id"),
                person.alias("customer_unique_id"),
                F.col("r_name").alias("customer_state"),
            )
        )

    @cached_property
    def sellers(self) -> DataFrame:
        return (
            self._star("supplier")
            .join(self._places(), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_suppkey").alias("seller_id"), F.col("r_name").alias("seller_state"))
        )

    @cached_property
    def products(self) -> DataFrame:
        return _products(self._star("part"))

    @cached_property
    def category_translation(self) -> DataFrame:
        english = F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")))
        return (
            self._star("part")
            .filter(~F.col("p_brand").isin("Brand#3", "Brand#7"))
            .select(
                F.col("p_brand").alias("product_category_name"),
                english.alias("product_category_name_english"),
            )
            .distinct()
        )
