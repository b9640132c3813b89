"""Loads that meet bad rows, and loads beside running reports."""

from __future__ import annotations

import json

import pytest
from market import rows
from test_sources import RAW

from bazaarlens.sources import warehouse
from bazaarlens.sources.quarantine import TooManyBadRows, bad_rows, good_rows, put_aside, read_text
from bazaarlens.sources.raw_csv import RAW_FILES, read_raw
from bazaarlens.sources.versions import current, drop_old
from bazaarlens.sources.warehouse import StoredMarketplace, load_raw, refresh

BROKEN_ITEMS = (
    "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
    "o1,1,p1,s1,2018-02-15 00:00:00,58.9,13.29\n"
    "o1,two,p1,s1,2018-02-15 00:00:00,58.9,13.29\n"
    "o1,3,p1,s1,2018-02-31 00:00:00,58.9,13.29\n"
    "o1,4,p1,s1,2018-02-15 00:00:00,12 reais,oops\n"
    "o1,5,p1,s1,2018-02-15 00:00:00,1.00\n"
    "o1,6,p1,s1,2018-02-15 00:00:00,1.00,2.00,3.00\n"
    'o1,7,"p1 s1,2018-02-15 00:00:00,1.00,2.00,3.00\n'
    "o1,8,p1,s1,,,\n"
)


def raw_files(folder, **changed):
    folder.mkdir(exist_ok=True)
    for table, text in {**RAW, **changed}.items():
        (folder / RAW_FILES[table].replace("*", "shop_")).write_text(text, newline="")
    return str(folder)


def test_good_and_bad_rows_are_told_apart(spark, tmp_path):
    text = read_text(spark, raw_files(tmp_path / "raw", order_items=BROKEN_ITEMS), "order_items")
    good = good_rows(text, "order_items")
    assert sorted(r["order_item_id"] for r in rows(good)) == [1, 8]
    assert good.dtypes == read_raw(spark, str(tmp_path / "raw"), "order_items").dtypes
    bad = {r["reason"]: r for r in rows(bad_rows(text, "order_items"))}
    assert {"order_item_id is no int: two", "shipping_limit_date is no timestamp_ntz: 2018-02-31 00:00:00", "price is no decimal(12,2): 12 reais", "not as many fields as the header"} == set(bad)
    assert all(r["table"] == "order_items" and r["file"].endswith("shop_order_items_dataset.csv") for r in bad.values())
    assert json.loads(bad["order_item_id is no int: two"]["record"])["order_item_id"] == "two"
    assert bad_rows(text, "order_items").count() == 6


@pytest.mark.parametrize("table", ["order_reviews", "orders", "products", "geolocation"])
def test_sound_files_give_the_same_rows_as_a_strict_read(spark, tmp_path, table):
    folder = raw_files(tmp_path / "raw")
    text = read_text(spark, folder, table)
    strict = read_raw(spark, folder, table)
    assert rows(good_rows(text, table)) == rows(strict) and good_rows(text, table).dtypes == strict.dtypes
    assert bad_rows(text, table).isEmpty()


def test_a_review_with_a_broken_score_or_quote_is_put_aside(spark, tmp_path):
    text = RAW["order_reviews"] + 'r2,o2,five,"a\nb",2018-02-21 00:00:00\nr3,o3,3,fine,2018-02-22 00:00:00\nr4,o4,1,"never closed,2018-02-21 00:00:00\n'
    raw = read_text(spark, raw_files(tmp_path / "raw", order_reviews=text), "order_reviews")
    assert sorted(r["review_id"] for r in rows(good_rows(raw, "order_reviews"))) == ["r1", "r3"]
    assert bad_rows(raw, "order_reviews").count() == 2


def test_too_many_bad_rows_fail_the_load_and_are_kept(spark, tmp_path):
    folder, store = raw_files(tmp_path / "raw", order_items=BROKEN_ITEMS), str(tmp_path / "tables")
    with pytest.raises(TooManyBadRows, match="order_items: 6 bad rows, 5 allowed"):
        load_raw(spark, folder, store, bad_rows=5)
    assert spark.read.parquet(f"{store}/quarantine/order_items").count() == 6
    assert not (tmp_path / "tables" / "order_items").exists()
    load_raw(spark, folder, store, bad_rows=6)
    assert StoredMarketplace(spark, store).order_items.count() == 2
    assert put_aside(read_text(spark, folder, "sellers"), store, "sellers", 0) == 0


def items(store):
    return sorted(r["order_id"] for r in rows(store.order_items.select("order_id")))


def test_readers_keep_the_version_they_opened(spark, tmp_path):
    store = str(tmp_path / "tables")
    first = refresh(spark, raw_files(tmp_path / "a"), store)
    assert current(spark, store) == first
    before = StoredMarketplace(spark, store)
    new = RAW["order_items"].replace("stray", "o2")
    refresh(spark, raw_files(tmp_path / "b", order_items=new), store)
    assert items(before) == ["o1", "stray"] and items(StoredMarketplace(spark, store)) == ["o1", "o2"]
    assert current(spark, str(tmp_path / "unversioned")) == str(tmp_path / "unversioned")


def test_a_load_killed_half_way_leaves_the_old_tables(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "tables")
    refresh(spark, raw_files(tmp_path / "a"), store)
    real = warehouse.store_table

    def killed(df, folder, table, *layout):
        if table == "order_items":
            df.limit(1).write.parquet(f"{folder}/{table}")
            raise KeyboardInterrupt
        real(df, folder, table, *layout)

    monkeypatch.setattr(warehouse, "store_table", killed)
    with pytest.raises(KeyboardInterrupt):
        refresh(spark, raw_files(tmp_path / "b"), store)
    assert items(StoredMarketplace(spark, store)) == ["o1", "stray"]
    monkeypatch.undo()
    with pytest.raises(TooManyBadRows):
        refresh(spark, raw_files(tmp_path / "c", order_items=BROKEN_ITEMS), store, bad_rows=0)
    assert items(StoredMarketplace(spark, store)) == ["o1", "stray"]


def test_old_versions_go_and_unfinished_ones_stay(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "tables")
    made = []
    monkeypatch.setattr(warehouse, "load_raw", lambda spark, raw, folder, **_: spark.range(1).write.parquet(f"{folder}/orders"))
    for _ in range(4):
        made.append(refresh(spark, "", store, keep=2))
    names = sorted(p.name for p in (tmp_path / "tables" / "versions").iterdir())
    assert names == [m.rsplit("/", 1)[1] for m in made[-2:]] and current(spark, store) == made[-1]
    (tmp_path / "tables" / "versions" / "99991231T000000000000-later").mkdir()
    assert drop_old(spark, store, keep=1) == [names[0]]
    assert sorted(p.name for p in (tmp_path / "tables" / "versions").iterdir()) == [names[1], "99991231T000000000000-later"]
    assert [p.name for p in (tmp_path / "tables").iterdir() if p.name.startswith(".current-")] == []
