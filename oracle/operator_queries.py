"""Single operators over the star-schema tables, and the way through files and back."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from decimal import Decimal
from functools import partial, reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.functions import rules
from bazaarlens.functions.metrics import amount, cents, count_where, mean, pct, per_100, sum_where
from bazaarlens.functions.periods import period_bucket
from bazaarlens.operators.cohort import cohort_repeat, started_with
from bazaarlens.operators.grain import (
    conditional_metrics,
    distinct_count,
    distinct_pairs,
    first_record_with_total,
    main_record,
    min_support,
)
from bazaarlens.operators.quality import dq_count
from bazaarlens.operators.ranking import dense_rank_desc, share_of_total
from bazaarlens.operators.reconcile import reconcile_totals
from bazaarlens.operators.scorecard import rollup_metric, scorecard
from bazaarlens.operators.segments import segment_by_rules
from bazaarlens.operators.skew import salted_join
from bazaarlens.params import Period
from bazaarlens.plans.datasets import Datasets
from bazaarlens.plans.freight import toxic_freight_split
from bazaarlens.schemas import FACT_TABLES
from bazaarlens.session import at_once, remove_dir, shared_dir, shuffles_dropped
from bazaarlens.sources.raw_csv import RAW_FILES
from bazaarlens.sources.results import export_csv
from bazaarlens.sources.star import STAR_PARAMS, STAR_SCHEMAS, StarMarketplace
from bazaarlens.sources.warehouse import StoredMarketplace, load_raw, store_table

MONEY = "decimal(12,2)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _line_value() -> Column:
    return cents(F.col("l_extendedprice").cast(MONEY))


def _rows() -> Column:
    return F.count(F.lit(1))


def period_bucket_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = [
        Period("1995-96", datetime(1995, 1, 1), datetime(1997, 1, 1)),
        Period("1997", datetime(1997, 1, 1), datetime(1998, 1, 1)),
        Period("1999", datetime(1999, 1, 1), datetime(2000, 1, 1)),
    ]
    bucket = period_bucket(F.col("o_orderdate"), spans).alias("span")
    return conditional_metrics(_table(spark, sf_dir, "orders"), [bucket], {"orders": _rows()})


def order_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = StarMarketplace(spark, sf_dir)
    items = tables.orders.join(tables.order_items, "order_id")
    keys = [
        rules.fulfillment_bucket().alias("fulfillment_attribution"),
        rules.delivery_status().alias("delivery_status"),
    ]
    metrics = {"items": _rows(), "late": count_where(rules.is_late()), "breach": count_where(rules.is_breach())}
    return conditional_metrics(items, keys, metrics)


def one_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = {"lines": _rows(), "value_cents": F.sum(_line_value())}
    per_order = conditional_metrics(_table(spark, sf_dir, "lineitem"), ["l_orderkey"], totals)
    return per_order.select("l_orderkey", "lines", amount(F.col("value_cents")).alias("line_value"))


def distinct_pairs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_pairs(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    quantity = F.sum(cents(F.col("l_quantity").cast(MONEY)))
    return conditional_metrics(
        lines,
        ["l_returnflag"],
        {
            "open_pct": pct(count_where(F.col("l_linestatus") == "O"), _rows()),
            "quantity_per_100": per_100(quantity, F.sum(_line_value())),
            "none_pct": pct(_rows(), count_where(F.lit(False))),
        },
    )


def conditional_metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    returned = F.col("l_returnflag") == "R"
    return conditional_metrics(
        lines,
        ["l_suppkey"],
        {
            "lines": _rows(),
            "returned_lines": count_where(returned),
            "returned_value": amount(sum_where(returned, _line_value())),
            "avg_returned_quantity": mean(F.when(returned, F.col("l_quantity").cast(MONEY))),
        },
    )


def share_of_total_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = {"value_cents": F.sum(_line_value())}
    per_supplier = conditional_metrics(_table(spark, sf_dir, "lineitem"), ["l_suppkey"], value)
    shared = share_of_total(per_supplier, "value_cents", "value_share_pct", many_rows=True)
    return shared.select("l_suppkey", "value_share_pct")


def dense_rank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = conditional_metrics(_table(spark, sf_dir, "orders"), ["o_custkey"], {"orders": _rows()})
    return dense_rank_desc(counts, "orders", "order_rank", many_rows=True)


def main_record_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast(MONEY).alias("line_value")
    )
    return main_record(lines, "l_orderkey", [F.desc("line_value"), F.asc("l_partkey"), F.asc("l_suppkey")])


def first_record_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_record_with_total(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


def segment_by_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    bands = [("owing", balance < 0), ("small", balance < 1000), ("large", balance >= 8000)]
    banded = segment_by_rules(_table(spark, sf_dir, "customer"), "band", bands, "middle")
    return conditional_metrics(banded, ["c_mktsegment", "band"], {"customers": _rows()})


def min_support_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = conditional_metrics(_table(spark, sf_dir, "lineitem"), ["l_partkey"], {"lines": _rows()})
    return min_support(counts, "lines", 30)


def corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = Datasets(StarMarketplace(spark, sf_dir), STAR_PARAMS).corridors
    keys = ("purchase_quarter", "seller_state", "customer_state")
    money = (amount(F.col(f"{name}_cents")).alias(name) for name in ("price", "freight"))
    return routes.select(*keys, "items", *money)


def reconcile_totals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    charged = conditional_metrics(
        _table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "order_id"),
        ["order_id"],
        {"line_value": F.sum(_line_value())},
    )
    paid = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), cents(F.col("o_totalprice").cast(MONEY)).alias("order_value")
    )
    return reconcile_totals(charged, paid, "order_id", F.col("line_value"), F.col("order_value"), 10_000_000)


def cohort_repeat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        "o_custkey",
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        "o_orderpriority",
    )
    first = first_record_with_total(orders, "o_custkey", "order_purchase_timestamp", "order_id")
    started = started_with(first, orders.select("order_id", "o_orderpriority"), datetime(1996, 1, 1))
    return cohort_repeat(started, "o_orderpriority", "first_priority", 10)


def category_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = Datasets(StarMarketplace(spark, sf_dir), STAR_PARAMS).product_categories
    return labels.select("product_id", "category_name")


def scorecard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    counts = conditional_metrics(
        orders, ["o_orderpriority"], {"n": _rows(), "filled": count_where(F.col("o_orderstatus") == "F")}
    )
    value = conditional_metrics(
        orders, ["o_orderpriority"], {"n": _rows(), "cents": F.sum(cents(F.col("o_totalprice").cast(MONEY)))}
    )
    sides = [
        rollup_metric(counts, "o_orderpriority", ["n", "filled"], {"filled_pct": pct(F.col("filled"), F.col("n"))}),
        rollup_metric(value, "o_orderpriority", ["n", "cents"], {"value": amount(F.col("cents"))}),
    ]
    size = rollup_metric(counts, "o_orderpriority", ["n"], {"orders": F.col("n")})
    keep = ["1-URGENT", "2-HIGH"]
    return scorecard(size, sides, "o_orderpriority", keep, "ALL").drop("is_total")


def dq_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").join(
        _table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    early = F.col("l_shipdate") < F.col("o_orderdate")
    return dq_count(lines, {"shipped_before_order": early, "free": F.col("l_extendedprice") <= 0}, "total_lines")


def distinct_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per supplier: an order with several of its lines counts once."""
    return distinct_count(_table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_orderkey", "orders")


def salted_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part counts as hot here, so that all rows take the split path."""
    lines = _table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = salted_join(lines, parts, "p_partkey", hot_rows=5)
    return conditional_metrics(joined, ["p_brand"], {"lines": _rows(), "value": amount(F.sum(_line_value()))})


def _raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The nine tables as raw files hold them; places stand in for the geolocation table."""
    tables = StarMarketplace(spark, sf_dir)
    places = _table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("geolocation_zip_code_prefix"), F.col("n_name").alias("geolocation_city")
    )
    found = {name: getattr(tables, name) for name in RAW_FILES if name != "geolocation"}
    raw = {name: df.drop("purchase_day", "order_day") for name, df in found.items()}
    return {**raw, "geolocation": places}


def _write_raw(df: DataFrame, raw_dir: str, table: str) -> None:
    """Raw files of one table, packed: a task reads a whole packed file, so each has a bounded number of rows."""
    packed = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 1_000_000}
    df.write.options(header=True, **packed).csv(f"{raw_dir}/{RAW_FILES[table].replace('*', 'shop_')}")


# Tables that are written, loaded and dropped as raw files together, so that the raw files of all are never there at once.
_LOADED_TOGETHER = ([t for t in RAW_FILES if t not in FACT_TABLES], ["order_items"], ["order_payments", "order_reviews"])


def load_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw CSV files to stored tables: rows per table, and the total of each table's amount if it has one."""
    folder = f"{shared_dir(spark)}/load-{uuid4().hex}"
    tables = _raw_tables(spark, sf_dir)
    for names in _LOADED_TOGETHER:
        with shuffles_dropped(spark):
            at_once(spark, [partial(_write_raw, tables[name], f"{folder}/raw", name) for name in names])
        load_raw(spark, f"{folder}/raw", f"{folder}/tables", names)
        remove_dir(spark, f"{folder}/raw")
    stored = StoredMarketplace(spark, f"{folder}/tables")
    amounts = {"order_items": "price", "order_payments": "payment_value"}
    counts = [
        getattr(stored, name).agg(
            F.lit(name).alias("table_name"),
            _rows().alias("row_count"),
            (F.sum(amounts[name]) if name in amounts else F.lit(Decimal(0))).cast("decimal(28,2)").alias("amount"),
        )
        for name in RAW_FILES
    ]
    return reduce(DataFrame.unionByName, counts)


def stored_tables_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read back from the stored table by month directory."""
    folder = f"{shared_dir(spark)}/stored-{uuid4().hex}"
    _write_raw(_raw_tables(spark, sf_dir)["orders"], f"{folder}/raw", "orders")
    load_raw(spark, f"{folder}/raw", f"{folder}/tables", ["orders"])
    remove_dir(spark, f"{folder}/raw")
    stored = StoredMarketplace(spark, f"{folder}/tables")
    orders = Datasets(stored, STAR_PARAMS).delivered_orders()
    return orders.select(
        F.col("order_id").cast("bigint").alias("order_id"),
        "order_status",
        "order_purchase_timestamp",
        "order_approved_at",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
    )


def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sellers' quarters from orders and items stored in buckets of the order id, joined without a shuffle."""
    folder = f"{shared_dir(spark)}/buckets-{uuid4().hex}"
    tables = StarMarketplace(spark, sf_dir)
    for name in ("orders", "order_items"):
        store_table(getattr(tables, name), folder, name, buckets=8)
    return Datasets(StoredMarketplace(spark, folder), STAR_PARAMS).seller_quarters


def export_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result written as CSV and read again."""
    folder = f"{shared_dir(spark)}/export-{uuid4().hex}"
    result = toxic_freight_split(Datasets(StarMarketplace(spark, sf_dir), STAR_PARAMS))
    export_csv(result, folder)
    kinds = ", ".join(f"{name} {kind}" for name, kind in result.dtypes)
    return spark.read.schema(kinds).option("header", True).option("nullValue", "NULL").csv(folder)


OPERATOR_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "s1_s3_load_round_trip": load_round_trip,
    "s4_stored_orders": stored_tables_query,
    "s5_export_round_trip": export_round_trip,
    "s6_bucketed_join": bucketed_join,
    "e1_period_bucket": period_bucket_query,
    "e2_order_rules": order_rules,
    "e3_one_per_order": one_per_order,
    "e4_distinct_pairs": distinct_pairs_query,
    "e5_ratios": ratios,
    "e6_conditional_metrics": conditional_metrics_query,
    "e7_share_of_total": share_of_total_query,
    "e8_dense_rank_desc": dense_rank_query,
    "e9_main_record": main_record_query,
    "e10_first_record_with_total": first_record_query,
    "e11_segment_by_rules": segment_by_rules_query,
    "e12_min_support": min_support_query,
    "e13_corridor": corridor,
    "e14_reconcile_totals": reconcile_totals_query,
    "e15_cohort_repeat": cohort_repeat_query,
    "e16_category_label": category_label,
    "e17_scorecard": scorecard_query,
    "e18_dq_count": dq_count_query,
    "e19_distinct_orders": distinct_count_query,
    "skew_salted_join": salted_join_query,
}
