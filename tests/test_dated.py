"""Orders and reviews stored by the month of their own date: chosen by the predicate, pruned, and never stale."""

from __future__ import annotations

import re

import pytest
from market import market, order
from test_skew import plan_of

from bazaarlens.plans.datasets import Datasets
from bazaarlens.plans.registry import JOBS
from bazaarlens.sources.star import STAR_PARAMS, StarMarketplace
from bazaarlens.sources.warehouse import StoredMarketplace, store_table

SF_DIR = "/root/testdata/sf0.001"
DATED = {
    "j1_6_review_intake_by_quarter": "creation_month",
    "j1_7_review_intake_by_month": "creation_month",
    "j1_8_late_rate_by_delivery_month": "delivery_month",
}


@pytest.fixture(scope="module")
def dated(spark, tmp_path_factory):
    folder, star = str(tmp_path_factory.mktemp("dated")), StarMarketplace(spark, SF_DIR)
    for name in ("orders", "order_reviews"):
        store_table(getattr(star, name), folder, name, dated=True)
    return StoredMarketplace(spark, folder)


@pytest.mark.parametrize("name", DATED)
def test_only_the_months_of_the_date_are_opened(spark, dated, name):
    job = JOBS[name](Datasets(dated, STAR_PARAMS))
    plan = plan_of(job)
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan).group(1)
    assert f"{DATED[name]}#" in filters and "1998-07-01" in filters
    assert plan.count("FileScan") == plan.count(f"PartitionFilters: [isnotnull({DATED[name]}#")
    want = JOBS[name](Datasets(StarMarketplace(spark, SF_DIR), STAR_PARAMS))
    assert list(map(repr, job.collect())) == list(map(repr, want.collect())) and want.count() > 1


def test_other_jobs_keep_the_layout_by_purchase(dated):
    plan = plan_of(JOBS["j1_1a_late_rate_by_quarter"](Datasets(dated, STAR_PARAMS)))
    assert "purchase_month#" in plan and "delivery_month" not in plan


def test_a_load_without_it_leaves_no_old_copy(spark, tmp_path):
    folder = str(tmp_path)
    first = market(spark, orders=[order("a"), order("b", order_delivered_customer_date=None)])
    store_table(first.orders, folder, "orders", dated=True)
    stored = StoredMarketplace(spark, folder)
    assert [r.order_id for r in stored.by_own_date("orders").collect()] == ["a"]
    assert [r.order_id for r in Datasets(stored).dated("orders").collect()] == ["a"]
    store_table(market(spark, orders=[order("c")]).orders, folder, "orders")
    stored = StoredMarketplace(spark, folder)
    assert stored.by_own_date("orders") is None and not (tmp_path / "orders_by_delivery").exists()
    assert [r.order_id for r in Datasets(stored).dated("orders").collect()] == ["c"]
    assert stored.by_own_date("order_reviews") is None
