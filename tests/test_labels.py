"""Items stored with their category: one shuffle for main categories, the same results, and never a stale label."""

from __future__ import annotations

import re

import pytest
from market import item, market, order
from test_skew import NO_BROADCAST, plan_of, settings

from bazaarlens.plans.datasets import Datasets
from bazaarlens.plans.registry import DATASETS, JOBS
from bazaarlens.sources.labels import ITEM_LABEL
from bazaarlens.sources.star import STAR_PARAMS, StarMarketplace
from bazaarlens.sources.warehouse import StoredMarketplace, store_table

SF_DIR = "/root/testdata/sf0.001"
TABLES = "products category_translation orders order_items order_payments order_reviews customers sellers".split()
LABELLED = ("j5_2_repeat_by_first_category", "j5_2b_repeat_six_months", "j5_3a_one_star_on_time", "j5_3b_multi_category_orders", "j5_5_category_scorecard", "v3_clean_delivered_items", "v6_main_category")


def load(spark, folder, names, buckets=0):
    star = StarMarketplace(spark, SF_DIR)
    for name in names:
        store_table(getattr(star, name), folder, name, buckets)
    return Datasets(StoredMarketplace(spark, folder), STAR_PARAMS)


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    return load(spark, str(tmp_path_factory.mktemp("labelled")), TABLES)


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    return load(spark, str(tmp_path_factory.mktemp("plain")), TABLES[2:] + TABLES[:2])


@pytest.mark.parametrize("name", LABELLED)
def test_same_results_with_and_without_labels(name, labelled, plain):
    assert labelled.category_key == ITEM_LABEL and plain.category_key == "product_id"
    job = {**JOBS, **DATASETS}[name]
    assert sorted(map(repr, job(labelled).collect())) == sorted(map(repr, job(plain).collect()))


def plans_of(spark, datasets, names):
    with settings(spark, **NO_BROADCAST, **{"spark.sql.adaptive.enabled": "false"}):
        unplanned = Datasets(datasets.tables, STAR_PARAMS)
        return {name: plan_of({**JOBS, **DATASETS}[name](unplanned)) for name in names}


def test_items_move_once_for_their_main_category(spark, labelled):
    plans = plans_of(spark, labelled, LABELLED)
    exchanges = {name: len(re.findall("Exchange hashpartitioning", plan)) for name, plan in plans.items()}
    assert exchanges["v6_main_category"] == 1
    assert exchanges["j5_2_repeat_by_first_category"] <= 6 and exchanges["j5_2b_repeat_six_months"] <= 6
    for name in LABELLED:
        assert "product_category_name" not in plans[name] and "hashpartitioning(product_id" not in plans[name], name


def test_the_scorecard_rolls_up_once(spark, labelled):
    plan = plans_of(spark, labelled, ["j5_5_category_scorecard"])["j5_5_category_scorecard"]
    assert len(re.findall("Exchange hashpartitioning", plan)) <= 12
    assert plan.count("Expand") == 1 and "isnull(category_name" not in plan


def test_no_exchange_of_items_with_labels_and_buckets(spark, tmp_path):
    both = load(spark, str(tmp_path), TABLES, buckets=4)
    plans = plans_of(spark, both, ["v6_main_category", "j5_3b_multi_category_orders"])
    assert "hashpartitioning" not in plans["v6_main_category"]
    assert plans["j5_3b_multi_category_orders"].count("Exchange hashpartitioning") == 0


def product(product_id, category):
    return {"product_id": product_id, "product_category_name": category}


def store(spark, folder, *names, **tables):
    given = market(spark, **tables)
    for name in names:
        store_table(getattr(given, name), folder, name)
    return Datasets(StoredMarketplace(spark, folder))


def label_of(d):
    return {r.order_id: r.category_name for r in d.main_category.collect()}


def test_labels_follow_the_products(spark, tmp_path):
    folder = str(tmp_path)
    basic = {"orders": [order("a"), order("b"), order("c")], "order_items": [item("a"), item("b", product_id="p2"), item("c", product_id="gone")]}
    d = store(spark, folder, "products", "category_translation", "orders", "order_items", **basic, products=[product("p1", "x"), product("p2", None)])
    first = label_of(d)
    assert d.category_key == ITEM_LABEL and set(first) == {"a", "b"}
    # Products alone are loaded again: the stored labels no longer count.
    d = store(spark, folder, "products", products=[product("p1", "y"), product("p2", "x"), product("gone", "x")])
    assert d.category_key == "product_id" and label_of(d) == {"a": "y", "b": "x", "c": "x"}
    # A translation changes labels too; items loaded again carry them.
    names = [{"product_category_name": "x", "product_category_name_english": "cross"}]
    d = store(spark, folder, "category_translation", category_translation=names)
    assert d.category_key == "product_id" and label_of(d)["b"] == "cross"
    d = store(spark, folder, "order_items", **basic)
    assert d.category_key == ITEM_LABEL and label_of(d)["b"] == "cross" and set(label_of(d)) == {"a", "b", "c"}
    # The same products again: still good.
    d = store(spark, folder, "products", products=[product("gone", "x"), product("p1", "y"), product("p2", "x")])
    assert d.category_key == ITEM_LABEL


def test_repeated_products_are_not_labelled(spark, tmp_path):
    tables = {"products": [product("p1", "x"), product("p1", "y")], "orders": [order("a")], "order_items": [item("a")]}
    d = store(spark, str(tmp_path), "products", "category_translation", "orders", "order_items", **tables)
    assert d.category_key == "product_id" and d.tables.order_items.count() == 1
