"""Numbers for text order ids: in their order, the same results, and hash aggregates only."""

from __future__ import annotations

import random

import pytest
from market import at, item, market, order
from test_skew import NO_BROADCAST, plan_of, settings

from bazaarlens.operators.grain import first_record_with_total
from bazaarlens.operators.numbering import dense_numbers
from bazaarlens.plans.datasets import Datasets, stored
from bazaarlens.plans.registry import JOBS
from bazaarlens.schemas import ORDER_KEY
from bazaarlens.sources.star import STAR_PARAMS, StarMarketplace
from bazaarlens.sources.warehouse import StoredMarketplace, store_table

SF_DIR = "/root/testdata/sf0.001"
TABLES = "products category_translation orders order_items order_payments order_reviews customers sellers".split()
JOBS_BY_FIRST = ("j4_6_repeat_by_first_payment", "j5_2_repeat_by_first_category", "j5_2b_repeat_six_months", "j5_5_category_scorecard")


class TextIds:
    """The star schema with order ids of 32 characters, in another order than the numbers."""

    def __init__(self, spark):
        self._star = StarMarketplace(spark, SF_DIR)

    def __getattr__(self, table):
        df = getattr(self._star, table)
        if "order_id" not in df.columns:
            return df
        return df.selectExpr("md5(cast(order_id as string)) as order_id", *(c for c in df.columns if c != "order_id"))


@pytest.fixture(scope="module")
def text_ids(spark, tmp_path_factory):
    folder, tables = str(tmp_path_factory.mktemp("text")), TextIds(spark)
    for name in TABLES:
        store_table(getattr(tables, name), folder, name)
    return StoredMarketplace(spark, folder)


def test_numbers_follow_the_order_without_gaps(spark):
    rng = random.Random(1)
    ids = [f"{rng.getrandbits(128):032x}" for _ in range(3000)] + [None, "", "Z", "é", "zz"]
    df = spark.createDataFrame([(i,) for i in ids + ids[:500]], "id string").repartition(7)
    got = {r.id: r.n for r in dense_numbers(df, "id", "n", stored).collect()}
    known = sorted((i for i in ids if i is not None), key=str.encode)
    assert got == {i: n for n, i in enumerate(known)}
    assert dense_numbers(df.limit(0), "id", "n", stored).count() == 0


def test_stored_tables_carry_the_same_numbers(spark, text_ids):
    orders = {r.order_id: r[ORDER_KEY] for r in text_ids.orders.select("order_id", ORDER_KEY).collect()}
    assert sorted(orders, key=str.encode) == sorted(orders, key=orders.get) and set(orders.values()) == set(range(len(orders)))
    for table in ("order_items", "order_payments", "order_reviews"):
        for r in getattr(text_ids, table).select("order_id", ORDER_KEY).distinct().collect():
            assert r[ORDER_KEY] == orders[r.order_id]


@pytest.mark.parametrize("name", JOBS_BY_FIRST)
def test_same_results_with_text_ids(spark, name, text_ids):
    with_keys = Datasets(text_ids, STAR_PARAMS)
    assert with_keys.order_ref == ORDER_KEY
    without = Datasets(TextIds(spark), STAR_PARAMS)
    assert without.order_ref == "order_id"
    assert sorted(map(repr, JOBS[name](with_keys).collect())) == sorted(map(repr, JOBS[name](without).collect()))


def test_a_report_over_text_ids(spark, text_ids, tmp_path):
    """Shared datasets are stored once, with every column once."""
    from bazaarlens.plans.report import write_report

    names = ["j2_1_dispatch_baseline", "j4_6_repeat_by_first_payment", "j5_2_repeat_by_first_category", "j5_3b_multi_category_orders"]
    write_report(Datasets(text_ids, STAR_PARAMS, keep=stored), str(tmp_path), names)
    for name in names:
        assert spark.read.option("header", True).csv(f"{tmp_path}/{name}").count() == JOBS[name](Datasets(text_ids, STAR_PARAMS)).count()


def test_no_job_sorts_to_aggregate(spark, text_ids, tmp_path):
    star, folder = StarMarketplace(spark, SF_DIR), str(tmp_path)
    for name in TABLES:
        store_table(getattr(star, name), folder, name)
    with settings(spark, **NO_BROADCAST, **{"spark.sql.adaptive.enabled": "false"}):
        for tables in (text_ids, StoredMarketplace(spark, folder)):
            for name, job in JOBS.items():
                assert "SortAggregate" not in plan_of(job(Datasets(tables, STAR_PARAMS))), name


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date"])
def test_packed_minimum_equals_the_struct_minimum(spark, kind):
    rng = random.Random(2)
    times = [None, "1969-12-31 23:59:59.999999", "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999", "2018-01-01 00:00:00.000001", "2018-01-01 00:00:00"]
    ids = [None, 0, 1, -1, 5, (1 << 63) - 1, -(1 << 63)]
    rows = [(rng.choice([None, *range(150)]), rng.choice(times), rng.choice(ids)) for _ in range(600)]
    rows += [(1000 + k, t, i) for k, (t, i) in enumerate((t, i) for t in times for i in ids)]
    df = spark.createDataFrame(rows, "owner int, t string, id long").selectExpr("owner", f"cast(t as {kind}) as t", "id")
    got = first_record_with_total(df, "owner", "t", "id")
    assert "SortAggregate" not in plan_of(got)
    df.createOrReplaceTempView("given")
    want = spark.sql("select owner, m.id, m.t, n from (select owner, min(struct(t, id)) as m, count(*) as n from given group by owner)")
    as_text = lambda df: sorted(map(repr, map(tuple, df.selectExpr("owner", "id", "cast(t as string)", df.columns[3]).collect())))
    assert as_text(got) == as_text(want)
    assert got.dtypes[1:3] == [("id", "bigint"), ("t", kind)]


def test_facts_of_unknown_orders_have_no_number(spark, tmp_path):
    tables = market(
        spark,
        orders=[order("b"), order("a", purchase="2018-02-09 10:00:00"), order("b", purchase="2018-03-01 00:00:00")],
        order_items=[item("a"), item("b"), item("x"), item(None)],
        order_payments=[{"order_id": i, "payment_type": t, "payment_value": "5.00"} for i, t in (("a", "card"), ("x", "cash"), ("y", "cash"))],
        customers=[{"customer_id": f"c-{i}", "customer_unique_id": "p", "customer_state": "SP"} for i in "ab"],
        products=[{"product_id": "p1", "product_category_name": "toys"}],
    )
    for name in TABLES:
        store_table(getattr(tables, name), str(tmp_path), name)
    d = Datasets(StoredMarketplace(spark, str(tmp_path)))
    keys = {r.order_id: r[ORDER_KEY] for r in d.tables.order_items.collect()}
    assert keys == {"a": 0, "b": 1, "x": None, None: None}
    assert [tuple(r) for r in d.first_orders.collect()] == [("p", 0, at("2018-02-09 10:00:00"), 3)]
    assert {r[ORDER_KEY]: r.payment_type for r in d.main_payment_by_key.collect()} == {0: "card"}
    assert {r.order_id for r in d.main_payment.collect()} == {"a", "x", "y"}
    assert {r[ORDER_KEY] for r in d.main_category_by_key.collect()} == {0, 1}
