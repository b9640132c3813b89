"""Tables in buckets: the same results, no shuffle under joins by order, pruned months, and a way out for hot orders."""

from __future__ import annotations

import re

import pytest
from market import item, market, order, rows
from test_skew import NO_BROADCAST, plan_of, settings

from bazaarlens.plans.datasets import Datasets
from bazaarlens.plans.registry import DATASETS, JOBS
from bazaarlens.sources import bucketed
from bazaarlens.sources.bucketed import buckets_of, spreads_evenly
from bazaarlens.sources.star import STAR_PARAMS, StarMarketplace
from bazaarlens.sources.warehouse import StoredMarketplace, store_table

SF_DIR = "/root/testdata/sf0.001"
TABLES = "orders order_items order_payments order_reviews customers sellers products category_translation".split()
JOINED = ("j2_1_dispatch_baseline", "j3_8_who_pays_freight", "j5_1_category_sales")


def load(spark, folder, buckets):
    star = StarMarketplace(spark, SF_DIR)
    for name in TABLES:
        store_table(getattr(star, name), folder, name, buckets)
    return Datasets(StoredMarketplace(spark, folder), STAR_PARAMS)


@pytest.fixture(scope="module")
def buckets(spark, tmp_path_factory):
    return load(spark, str(tmp_path_factory.mktemp("buckets")), 6)


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    return load(spark, str(tmp_path_factory.mktemp("plain")), 0)


@pytest.fixture(scope="module")
def plans(spark, buckets):
    with settings(spark, **NO_BROADCAST, **{"spark.sql.adaptive.enabled": "false"}):
        return {name: plan_of({**JOBS, **DATASETS}[name](buckets)) for name in (*JOINED, "v1_one_review", "v2_seller_quarters")}


def below(plan, node):
    """The lines of the subtree under the first line with the node."""
    lines = plan.splitlines()
    k = next(k for k, line in enumerate(lines) if node in line)
    depth = len(re.match(r"[\s:+\-]*", lines[k]).group())
    out = []
    for line in lines[k + 1 :]:
        if len(re.match(r"[\s:+\-]*", line).group()) <= depth:
            break
        out.append(line)
    return out


def test_joins_by_order_have_no_exchange_under_them(plans):
    for name in JOINED[:2]:
        assert not any("Exchange" in line for line in below(plans[name], "SortMergeJoin")), name
    # j5_1 goes on to products, which are shuffled; orders and items are not.
    assert "Exchange hashpartitioning(order_id" not in plans["j5_1_category_sales"]
    assert "Exchange" not in plans["v1_one_review"]
    assert "hashpartitioning(order_id" not in plans["v2_seller_quarters"]


def test_buckets_are_read_as_such_and_months_pruned(plans):
    for name in JOINED:
        scans = [line for line in plans[name].splitlines() if "FileScan" in line and "order_id#" in line]
        assert len(scans) == (3 if name == "j3_8_who_pays_freight" else 2)
        for scan in scans:
            assert "Bucketed: true" in scan and "SelectedBucketsCount: 6 out of 6" in scan
            assert re.search(r"PartitionFilters: \[[^\]]*(?:purchase|order)_month#", scan) and "1998-07-01" in scan


@pytest.mark.parametrize("name", [*JOINED, "j1_3_review_by_lateness", "j4_6_repeat_by_first_payment", "j5_5_category_scorecard", "v2_seller_quarters"])
def test_same_results_in_either_layout(name, buckets, plain):
    job = {**JOBS, **DATASETS}[name]
    as_set = lambda df: sorted(map(repr, df.collect()))
    assert as_set(job(buckets)) == as_set(job(plain))


def test_a_hot_order_leaves_its_table_in_the_plain_layout(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bucketed.spreads_evenly, "__defaults__", (4, 50))
    tables = market(
        spark,
        orders=[order(f"o{i}") for i in range(100)],
        order_items=[item(f"o{i}") for i in range(100)] + [item("o7", k + 2) for k in range(500)],
    )
    for name in ("orders", "order_items"):
        store_table(getattr(tables, name), str(tmp_path), name, 8)
    assert (buckets_of(spark, str(tmp_path), "orders"), buckets_of(spark, str(tmp_path), "order_items")) == (8, 0)
    stored = StoredMarketplace(spark, str(tmp_path))
    assert stored.orders.join(stored.order_items, "order_id").count() == 600


def test_evenness(spark):
    ids = spark.range(10_000).selectExpr("cast(id as string) as order_id")
    assert spreads_evenly(ids, 8, small=10)
    assert not spreads_evenly(ids.union(spark.range(9000).selectExpr("'x' as order_id")), 8, small=10)
    assert spreads_evenly(ids.limit(0), 8) and spreads_evenly(spark.range(500).selectExpr("cast(null as string) as order_id"), 8)


def test_a_refresh_may_change_the_layout(spark, tmp_path):
    first = market(spark, orders=[order("a"), order("b")], order_items=[item("a"), item("b"), item(None)])
    second = market(spark, orders=[order("c"), order("b", purchase="2017-03-01 00:00:00")], order_items=[item("c"), item("c", 2)])
    for tables, buckets, ids in ((first, 4, "ab"), (second, 3, "bc"), (first, 0, "ab"), (second, 2, "bc")):
        for name in ("orders", "order_items"):
            store_table(getattr(tables, name), str(tmp_path), name, buckets)
        stored = StoredMarketplace(spark, str(tmp_path))
        assert sorted(r["order_id"] for r in rows(stored.orders)) == list(ids)
        assert stored.order_items.count() == (3 if ids == "ab" else 2)
        assert buckets_of(spark, str(tmp_path), "order_items") == buckets
