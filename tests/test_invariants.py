"""Relations between results that must hold on any data."""

from __future__ import annotations

from decimal import Decimal

import pytest
from market import rows
from pyspark.sql import functions as F

from bazaarlens.plans.datasets import Datasets
from bazaarlens.plans.registry import JOBS
from bazaarlens.sources.star import STAR_PARAMS, StarMarketplace

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def d(spark):
    return Datasets(StarMarketplace(spark, SF_DIR), STAR_PARAMS)


@pytest.fixture(scope="module")
def result(d):
    cache = {}

    def run(name):
        (full,) = [job for job in JOBS if job.startswith(name + "_")]
        if full not in cache:
            cache[full] = rows(JOBS[full](d))
        return cache[full]

    return run


def total(results, column):
    return sum(row[column] for row in results)


def test_item_totals_agree(result):
    items = total(result("j3_1"), "total_items")
    assert items == total(result("j3_2"), "total_items")
    assert items == total(result("j3_3"), "total_delivered_items")
    assert items == total(result("j3_4"), "total_items")
    assert items == total(result("j3_5"), "total_items")
    assert items == total(result("j3_7"), "total_items")
    assert items == total(result("j5_1"), "total_item_sold")
    assert items >= total(result("j2_1"), "total_dispatched_items") == result("j2_9")[0]["total_items"]


def test_matrix_leaves_out_only_undelivered_items(d, result):
    later = [r for r in result("j2_1") if r["purchase_quarter"] == d.params.later.label]
    undelivered = (
        d.dispatched_items(d.params.later).filter(F.col("order_delivered_customer_date").isNull()).count()
    )
    assert total(result("j2_2"), "total_items") == total(later, "total_dispatched_items") - undelivered
    assert abs(total(result("j2_2"), "pct_of_total") - 100) <= Decimal("0.02")


def test_freight_totals_agree(result):
    freight = total(result("j3_1"), "total_freight")
    assert freight == total(result("j3_4"), "total_freight_value")
    paid = result("j3_8")[0]
    assert paid["total_orders"] <= total(result("j3_1"), "total_orders")
    local = [r for r in result("j3_4") if r["shipping_type"] == "Local"]
    assert total(local, "total_items") == total(result("j3_7"), "local_items")


def test_customer_counts_agree(result):
    everyone = total(result("j4_4"), "total_unique_customers")
    payers = total(result("j4_5"), "total_customers")
    assert payers <= everyone
    assert total(result("j4_6"), "total_customers") <= everyone
    by_category = total(result("j5_2"), "total_customers")
    assert by_category <= everyone


def test_reviewed_orders_and_reviews_agree(result):
    assert total(result("j1_3"), "total_orders") == total(result("j1_4"), "total_orders")
    assert total(result("j1_6"), "total_reviews") == total(result("j1_7"), "total_reviews")


def test_scorecard_repeats_the_lists(result):
    card = {r["category_name"]: r for r in result("j5_5")}
    repeat = {r["first_order_category"]: r["came_back_pct"] for r in result("j5_2")}
    sales = {r["category_name"]: r for r in result("j5_1")}
    kept = [name for name in card if name != "ALL CATEGORIES"]
    assert len(kept) == 5
    for name in kept:
        assert card[name]["came_back_pct"] == repeat[name]
        assert card[name]["gmv_share_pct"] == sales[name]["GMV_share_pct"]
        assert card[name]["avg_item_price"] == sales[name]["avg_item_price"]
    everything = result("j5_5")[-1]
    assert everything["category_name"] == "ALL CATEGORIES"
    assert everything["gmv_share_pct"] == Decimal("100.00")
    assert everything["avg_item_price"] == result("j5_1")[0]["overall_avg_item_price"]


def test_running_share_ends_at_everything(result):
    assert result("j5_1")[-1]["cumulative_top_GMV_Share_pct"] == Decimal("100.00")


def test_traps_are_in_the_data(d):
    """The data would show a difference if a rule were dropped."""
    arrived = d.delivered_orders().filter(F.col("order_delivered_customer_date").isNotNull())
    by_time = F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")
    by_date = F.to_date("order_delivered_customer_date") > F.to_date("order_estimated_delivery_date")
    assert arrived.filter(by_time & ~by_date).count() == 26
    assert d.one_review.filter("review_score = 1.5").count() > 0
    assert d.tables.order_payments.groupBy("order_id").count().filter("count > 1").count() > 0
