"""One key with a third of all rows: results stay whole, and no task gets the whole key."""

from __future__ import annotations

from contextlib import contextmanager
from types import SimpleNamespace

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.operators.grain import first_record_with_total, main_record, numbered_records
from bazaarlens.operators.ranking import dense_rank_desc
from bazaarlens.operators.skew import hot_keys, salted_join
from bazaarlens.plans import sellers
from bazaarlens.plans.datasets import Datasets

ROWS = 60_000


@contextmanager
def settings(spark, **conf):
    old = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture(scope="module")
def facts(spark):
    """A third of the rows belong to one key, some to none."""
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit("hot")).when(n % 50 == 1, F.lit(None)).otherwise((n % 900).cast("string"))
    return spark.range(0, ROWS, 1, 8).select(key.alias("key"), n.alias("value"), (n % 7).alias("other"))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_hot_keys_are_found(facts):
    found = {row["_hot"]: row["_pieces"] for row in hot_keys(facts, "key", hot_rows=1000).collect()}
    assert found == {"hot": ROWS // 3 // 1000}
    assert hot_keys(facts, "key").count() == 0


def test_salted_join_equals_plain_join(facts):
    lookup = facts.select("key").distinct().filter("key <> '7'").withColumn("size", F.length("key"))
    expected = sorted_rows(facts.join(lookup, "key").select("key", "value", "other", "size"))
    for hot_rows in (1, 50, 1000, 10**9):
        joined = salted_join(facts, lookup, "key", hot_rows).select("key", "value", "other", "size")
        assert sorted_rows(joined) == expected


def test_salted_join_spreads_the_hot_key(spark, facts):
    lookup = facts.select("key").distinct().filter(F.col("key").isNotNull())
    off = {**NO_BROADCAST, "spark.sql.adaptive.enabled": "false"}
    with settings(spark, **off):
        largest = []
        for joined in (facts.join(lookup, "key"), salted_join(facts, lookup, "key", 500)):
            sizes = joined.groupBy(F.spark_partition_id()).count().collect()
            largest.append(max(row["count"] for row in sizes))
    assert largest[0] > ROWS / 3
    assert largest[1] < ROWS / 4


def test_equal_rows_of_one_key_are_spread(spark):
    facts = spark.range(0, ROWS, 1, 8).selectExpr("if(id % 3 = 0, 'hot', string(id)) AS key", "1 AS value")
    lookup = facts.select("key").distinct().withColumn("size", F.length("key"))
    with settings(spark, **NO_BROADCAST, **{"spark.sql.adaptive.enabled": "false"}):
        joined = salted_join(facts, lookup, "key", 500)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    assert max(row["count"] for row in sizes) < ROWS / 4
    assert sorted_rows(joined) == sorted_rows(facts.join(lookup, "key"))


def test_three_thousand_hot_keys_are_all_found(spark):
    facts = spark.range(0, 90_000, 1, 8).selectExpr("id % 3000 AS key", "id AS value")
    assert hot_keys(facts, "key", hot_rows=30).count() == 3000
    assert hot_keys(facts, "key", hot_rows=31).count() == 0


def test_salted_join_of_nothing(spark, facts):
    lookup = facts.select("key").distinct()
    assert salted_join(facts.filter("value < 0"), lookup, "key").count() == 0


def test_numbered_records_equal_a_window_over_the_owner(spark, tmp_path):
    n = F.col("id")
    records = spark.range(0, 5000, 1, 8).select(
        F.when(n % 3 == 0, F.lit("hot")).when(n % 100 == 1, F.lit(None)).otherwise((n % 90).cast("string")).alias("who"),
        n.alias("record"),
        (F.expr("timestamp_ntz'2018-01-01 00:00:00'") + (n * 7919 % 2000) * F.expr("INTERVAL '47' MINUTE")).alias("at"),
    )
    records.withColumn("at", F.when(F.col("record") % 97 != 5, F.col("at"))).write.parquet(f"{tmp_path}/records")
    records = spark.read.parquet(f"{tmp_path}/records")
    owner = W.partitionBy("who")
    expected = records.select(
        "who",
        "record",
        "at",
        F.row_number().over(owner.orderBy("at", "record")).alias("order_no"),
        F.count(F.lit(1)).over(owner).alias("total_orders"),
    )
    numbered = numbered_records(records, "who", "at", "record")
    assert sorted_rows(numbered) == sorted_rows(expected)
    with settings(spark, **NO_BROADCAST, **{"spark.sql.adaptive.enabled": "false"}):
        plan = plan_of(numbered_records(records, "who", "at", "record"))
        # By (owner, day), read twice; by owner over days; and the days back to (owner, day).
        assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") == 3
    first = first_record_with_total(records, "who", "at", "record")
    assert sorted_rows(first) == sorted_rows(
        expected.filter("order_no = 1").select("who", "record", "at", "total_orders")
    )


def test_first_records_are_combined_before_the_shuffle(facts):
    plan = plan_of(first_record_with_total(facts, "key", "value", "other"))
    assert "partial_min" in plan
    assert "Window" not in plan


def test_main_record_is_limited_before_the_shuffle(facts):
    plan = plan_of(main_record(facts, "key", [F.desc("value")]))
    partial, final = plan.index(", Partial"), plan.index(", Final")
    assert final < plan.index("Exchange hashpartitioning(key") < partial


def test_dense_rank_by_values_equals_window(facts):
    counts = facts.groupBy("value").agg(F.max("other").alias("n"))
    expected = sorted_rows(dense_rank_desc(counts, "n", "rank"))
    assert sorted_rows(dense_rank_desc(counts, "n", "rank", many_rows=True)) == expected


def test_an_order_with_a_third_of_all_items_is_split(spark):
    """Items meet their orders in a join that adaptive execution can split."""
    n = F.col("id")
    stamp = "timestamp_ntz'2018-05-{day} 10:00:00'"
    orders = spark.range(0, 3000, 1, 4).select(
        n.cast("string").alias("order_id"),
        n.cast("string").alias("customer_id"),
        F.lit("delivered").alias("order_status"),
        F.expr(stamp.format(day="01")).alias("order_purchase_timestamp"),
        F.expr(stamp.format(day="01")).alias("order_approved_at"),
        F.expr(stamp.format(day="04")).alias("order_delivered_carrier_date"),
        F.expr(stamp.format(day="09")).alias("order_delivered_customer_date"),
        F.expr(stamp.format(day="08")).alias("order_estimated_delivery_date"),
    )
    items = spark.range(0, ROWS, 1, 16).select(
        F.when(n % 3 == 0, F.lit("7")).otherwise((n % 3000).cast("string")).alias("order_id"),
        n.cast("int").alias("order_item_id"),
        F.lit("p").alias("product_id"),
        (n % 40).cast("string").alias("seller_id"),
        F.expr(stamp.format(day="03")).alias("shipping_limit_date"),
        F.lit(1).cast("decimal(12,2)").alias("price"),
        F.lit(1).cast("decimal(12,2)").alias("freight_value"),
    )
    d = Datasets(SimpleNamespace(orders=orders, order_items=items))
    small = {
        **NO_BROADCAST,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    with settings(spark, **small):
        for job in (sellers.dispatch_baseline, lambda d: d.seller_quarters):
            result = job(d)
            rows = result.collect()
            assert "skew=true" in plan_of(result)
    assert sum(row["q2_total_items"] for row in rows) == ROWS
