"""Large loads go by portions of the orders, and leave neither shuffled data nor raw files of our own behind."""

from __future__ import annotations

import time
from pathlib import Path

import pytest
from market import item, market, order, rows
from pyspark.sql import functions as F
from test_sources import RAW

from bazaarlens.schemas import FACT_TABLES, ORDER_KEY
from bazaarlens.session import shared_dir, shuffles_dropped
from bazaarlens.sources import warehouse
from bazaarlens.sources.raw_csv import RAW_FILES, raw_bytes
from bazaarlens.sources.warehouse import StoredMarketplace, load_raw, store_table

DEALT = ("orders", *FACT_TABLES)
LOADED = ("products", "category_translation", *DEALT)


def some_market(spark):
    """Orders of several months, one without a time, ids repeated in one month and in two, facts of unknown and of no orders."""
    ids = [f"o{n:03d}" for n in range(40)]
    orders = [order(i, f"2018-{n % 5 + 1:02d}-10 10:00:00") for n, i in enumerate(ids)]
    orders += [order("o001", "2018-02-11 10:00:00"), order("o002", "2018-07-11 10:00:00"), order("timeless", None), order(None)]
    facts = [*ids, "o001", "stray", "timeless", None]
    return market(
        spark,
        orders=orders,
        order_items=[item(i, n + 1, product_id="p1" if n else "p2") for i in facts for n in range(3)],
        order_payments=[{"order_id": i, "payment_type": "card", "payment_value": "5.00"} for i in facts],
        order_reviews=[{"order_id": i, "review_score": 4, "review_creation_date": "2018-05-01 00:00:00"} for i in facts],
        products=[{"product_id": "p1", "product_category_name": "brinquedos"}],
        category_translation=[{"product_category_name": "brinquedos", "product_category_name_english": "toys"}],
    )


def stored(spark, folder):
    tables = StoredMarketplace(spark, folder)
    return {t: (getattr(tables, t).dtypes, sorted(map(repr, map(tuple, getattr(tables, t).collect())))) for t in DEALT}


def test_portions_give_the_same_tables(spark, tmp_path):
    given, whole, dealt = some_market(spark), str(tmp_path / "whole"), str(tmp_path / "dealt")
    for name in LOADED:
        store_table(getattr(given, name), whole, name)
        for _ in range(2):  # the second time it replaces what is there
            store_table(getattr(given, name), dealt, name, 0, False, 3)
    want = stored(spark, whole)
    assert stored(spark, dealt) == want
    assert any("toys" in row for row in want["order_items"][1]) and (ORDER_KEY, "bigint") in want["order_items"][0]
    assert {p.name for p in (tmp_path / "dealt").iterdir()} == {p.name for p in (tmp_path / "whole").iterdir()}


@pytest.mark.parametrize("portions", [1, 2])
def test_portions_of_ids_of_two_types(spark, tmp_path, portions):
    """Ids that are equal to a join meet, though their hashes differ."""
    known = range(20)
    orders = market(spark, orders=[order(str(n)) for n in known]).orders
    store_table(orders.withColumn("order_id", F.col("order_id").cast("bigint")), str(tmp_path), "orders", 0, False, portions)
    text = spark.createDataFrame([(f"00{i}", "card", 5) for i in known], "order_id string, payment_type string, payment_value int")
    store_table(text, str(tmp_path), "order_payments", 0, False, portions)
    assert StoredMarketplace(spark, str(tmp_path)).order_payments.filter("order_month is not null").count() == len(known)


def raw_files(folder, **changed):
    folder.mkdir(exist_ok=True)
    for table, text in {**RAW, **changed}.items():
        (folder / RAW_FILES[table].replace("*", "shop_")).write_text(text, newline="")
    return str(folder)


def test_a_load_deals_large_tables(spark, tmp_path, monkeypatch):
    raw, tables = raw_files(tmp_path / "raw"), str(tmp_path / "tables")
    assert raw_bytes(spark, raw, "order_items") == len(RAW["order_items"]) and raw_bytes(spark, str(tmp_path), "orders") == 0
    load_raw(spark, raw, tables)
    want, real, portions = stored(spark, tables), warehouse.store_table, {}

    def noting(df, folder, table, buckets, dated, n):
        portions[table] = n
        real(df, folder, table, buckets, dated, n)

    monkeypatch.setattr(warehouse, "store_table", noting)
    load_raw(spark, raw, tables)
    assert set(portions.values()) == {1}
    monkeypatch.setattr(warehouse, "_PORTION_BYTES", len(RAW["order_items"]) // 2)
    load_raw(spark, raw, tables)
    assert portions["order_items"] == 3 and portions["order_payments"] == 1
    monkeypatch.setattr(warehouse, "_PORTION_BYTES", 1)
    load_raw(spark, raw, tables)
    assert {portions[t] for t in DEALT} == {8}
    assert stored(spark, tables) == want

    # A value of another type is met before the table is touched.
    broken = raw_files(tmp_path / "broken", order_items=RAW["order_items"].replace("58.9", "many"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        load_raw(spark, broken, tables)
    assert stored(spark, tables) == want
    assert not list((tmp_path / "tables").glob("portions_of_*"))


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in files.mkString("\n").split("\n") if Path(name).name.startswith("shuffle_")}


def test_a_load_leaves_no_shuffled_data(spark, tmp_path):
    before = shuffle_files(spark)
    load_raw(spark, raw_files(tmp_path / "raw"), str(tmp_path / "tables"))
    for _ in range(50):  # they are deleted aside
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left


@pytest.mark.parametrize("before", [None, "false", "true"])
def test_the_setting_is_put_back(spark, before):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if before:
        spark.conf.set(key, before)
    try:
        was = spark.conf.get(key)
        with pytest.raises(KeyError), shuffles_dropped(spark):
            assert spark.conf.get(key) == "true"
            raise KeyError
        assert spark.conf.get(key) == was
    finally:
        spark.conf.unset(key)


def test_the_round_trip_drops_its_raw_files(spark, monkeypatch):
    from oracle import operator_queries

    shared = Path(shared_dir(spark).removeprefix("file:"))
    before, real, there = set(shared.glob("load-*")), operator_queries.load_raw, []

    def noting(spark, raw_dir, *rest):
        files = list(Path(raw_dir).glob("*/part-*"))
        there.append({p.parent.name for p in files})
        assert all(p.name.endswith(".csv.gz") for p in files)
        real(spark, raw_dir, *rest)

    monkeypatch.setattr(operator_queries, "load_raw", noting)
    counts = {r["table_name"]: r["row_count"] for r in rows(operator_queries.load_round_trip(spark, "/root/testdata/sf0.001"))}
    assert set(counts) == set(RAW_FILES) and all(counts.values())
    names = {t: name.replace("*", "shop_") for t, name in RAW_FILES.items()}
    assert [len(tables) for tables in there] == [6, 1, 2] and set().union(*there) == set(names.values())
    (folder,) = set(shared.glob("load-*")) - before
    assert {p.name for p in folder.iterdir()} == {"tables"}
