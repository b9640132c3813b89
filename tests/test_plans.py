"""The shape of the plans: what reaches the scan, what is shuffled, and what is not there at all."""

from __future__ import annotations

import re

import pytest
from test_skew import NO_BROADCAST, plan_of, settings

from bazaarlens.plans.datasets import Datasets
from bazaarlens.plans.registry import DATASETS, JOBS
from bazaarlens.sources.star import STAR_PARAMS, StarMarketplace
from bazaarlens.sources.warehouse import StoredMarketplace, store_table

SF_DIR = "/root/testdata/sf0.001"
TABLES = "orders order_items order_payments order_reviews customers sellers products category_translation".split()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    star = StarMarketplace(spark, SF_DIR)
    for name in TABLES:
        store_table(getattr(star, name), folder, name)
    return Datasets(StoredMarketplace(spark, folder), STAR_PARAMS)


@pytest.fixture(scope="module")
def plans(spark, stored):
    """Static plans as they would be for tables too large to broadcast."""
    with settings(spark, **NO_BROADCAST, **{"spark.sql.adaptive.enabled": "false"}):
        return {name: plan_of(job(stored)) for name, job in {**JOBS, **DATASETS}.items()}


def test_no_cross_joins_and_no_python(plans):
    for name, plan in plans.items():
        for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
            assert node not in plan, (name, node)


def test_nothing_is_broadcast_by_request(plans):
    for name, plan in plans.items():
        assert "BroadcastHashJoin" not in plan, name


def test_single_partitions_hold_aggregated_rows_only(plans):
    """Below an exchange to one partition comes an aggregate, with nothing between that reads or joins rows."""
    harmless = ("Project", "Filter", "Window", "Sort ", "Exchange SinglePartition", "TakeOrderedAndProject")
    for name, plan in plans.items():
        lines = plan.splitlines()
        for k, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                first = next(x for x in lines[k + 1 :] if not any(node in x for node in harmless))
                assert any(node in first for node in ("Aggregate", "Join", "Expand", "Union")), (name, first)


def test_nothing_before_the_final_aggregate_is_one_task(plans):
    for name, plan in plans.items():
        assert "Coalesce 1" not in plan, name


def test_building_a_job_starts_none(spark, stored, tmp_path):
    """No job writes or runs anything while it is planned."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        for job in JOBS.values():
            job(stored)
        assert not tracker.getJobIdsForGroup("planning")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_the_scorecard_reads_items_twice(plans):
    """The half-year's items once for money and scores, and the history's items for main categories."""
    plan = plans["j5_5_category_scorecard"]
    assert len(re.findall(r"FileScan parquet \[[^\]]*product_id#[^\]]*order_month#", plan)) == 2


def test_items_are_read_once_for_scores(plans):
    """Alike items become one row before they meet their order: one scan, and no list of hot keys."""
    shuffles = {"j2_7_review_by_bucket": 7, "j2_8_review_by_seller_group": 7, "j5_3a_one_star_on_time": 10}
    for name, most in shuffles.items():
        assert plans[name].count("freight_value") == 0
        assert len(re.findall(r"FileScan parquet \[[^\]]*(?:shipping_limit_date|product_id)#[^\]]*order_month#", plans[name])) == 1, name
        assert len(re.findall("Exchange hashpartitioning", plans[name])) <= most, name


def test_quarter_jobs_open_only_their_months(plans):
    scan = r"FileScan parquet \[([^\]]*)\].*?PartitionFilters: \[([^\]]*)\]"
    scans = re.findall(scan, plans["j2_2_fulfillment_matrix"])
    assert len(scans) == 2
    for columns, filters in scans:
        month = "purchase_month" if "purchase_month" in columns else "order_month"
        assert f"{month}#" in filters
        assert "1998-04-01" in filters
        assert "1998-07-01" in filters


def test_filters_and_columns_reach_the_scan(plans):
    plan = plans["j1_1a_late_rate_by_quarter"]
    assert "GreaterThanOrEqual(order_purchase_timestamp" in plan
    assert "EqualTo(order_status,delivered)" in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "customer_id" not in schema
    assert "order_approved_at" not in schema


def test_items_are_shuffled_once_for_item_counts(plans):
    plan = plans["j2_1_dispatch_baseline"]
    assert len(re.findall(r"Exchange hashpartitioning\(order_id", plan)) == 2
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 3


def test_order_totals_join_without_another_shuffle(plans):
    """Items, payments and orders each move once, by order."""
    assert len(re.findall(r"Exchange hashpartitioning", plans["j3_8_who_pays_freight"])) == 3


def test_customer_history_has_no_window_over_a_person(plans):
    for name in ("j4_4_customer_frequency", "j4_6_repeat_by_first_payment", "j5_2_repeat_by_first_category"):
        assert not re.search(r"Window \[[^\n]*windowspecdefinition\(customer_unique_id", plans[name]), name


def test_top_ten_keeps_ten_rows_per_task(spark, stored):
    assert "TakeOrderedAndProject(limit=10" in plan_of(JOBS["j3_6_top_corridors"](stored))
