"""Raw files to tables to results."""

from __future__ import annotations

import csv
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest
from market import rows

from bazaarlens.params import Params
from bazaarlens.plans.datasets import Datasets, stored
from bazaarlens.plans.registry import JOBS
from bazaarlens.plans.report import write_report
from bazaarlens.session import shared_dir
from bazaarlens.sources.raw_csv import RAW_FILES, read_raw
from bazaarlens.sources.results import export_csv
from bazaarlens.sources.warehouse import StoredMarketplace, load_raw

RAW = {
    "customers": "customer_state,customer_id,customer_unique_id,customer_city\nRJ,c1,ann,rio\nSP,c2,ann,sao paulo\n",
    "orders": (
        "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
        "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
        "o1,c1,delivered,2018-02-10 10:00:00,2018-02-10 12:00:00,2018-02-12 09:00:00,"
        "2018-02-20 15:00:00,2018-02-28 00:00:00\n"
        "o2,c2,canceled,2018-05-10 10:00:00,,,,2018-05-28 00:00:00\n"
    ),
    "order_items": (
        "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
        "o1,1,p1,s1,2018-02-15 00:00:00,58.9,13.29\n"
        "stray,1,p1,s1,2018-02-15 00:00:00,1,1\n"
    ),
    "order_payments": "order_id,payment_sequential,payment_type,payment_value\no1,1,voucher,72.19\n",
    "order_reviews": (
        "review_id,order_id,review_score,review_comment_message,review_creation_date\n"
        'r1,o1,4,"line one\nsaid ""fine"", twice",2018-02-21 00:00:00\n'
    ),
    "products": (
        "product_id,product_category_name,product_weight_g,product_length_cm,product_height_cm,product_width_cm\n"
        "p1,,225.0,16,10,14\n"
    ),
    "sellers": "seller_id,seller_city,seller_state\ns1,sao paulo,SP\n",
    "geolocation": "geolocation_zip_code_prefix,geolocation_lat\n01037,-23.5\n",
    "category_translation": "product_category_name,product_category_name_english\nbrinquedos,toys\n",
}


@pytest.fixture
def raw_dir(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for table, text in RAW.items():
        (folder / RAW_FILES[table].replace("*", "shop_")).write_text(text, newline="")
    return folder


def test_columns_are_found_by_name_and_typed(spark, raw_dir):
    (first, second) = rows(read_raw(spark, str(raw_dir), "customers").orderBy("customer_id"))
    assert first["customer_state"] == "RJ"
    (item,) = rows(read_raw(spark, str(raw_dir), "order_items").filter("order_id = 'o1'"))
    assert (item["price"], item["order_item_id"]) == (Decimal("58.90"), 1)
    assert item["shipping_limit_date"] == datetime(2018, 2, 15)
    lost = rows(read_raw(spark, str(raw_dir), "orders").filter("order_id = 'o2'"))[0]
    assert lost["order_approved_at"] is None
    (place,) = rows(read_raw(spark, str(raw_dir), "geolocation"))
    assert place["geolocation_zip_code_prefix"] == "01037"


def test_review_text_may_hold_lines_and_quotes(spark, raw_dir):
    (review,) = rows(read_raw(spark, str(raw_dir), "order_reviews"))
    assert review["review_comment_message"] == 'line one\nsaid "fine", twice'
    assert review["review_score"] == 4


def test_a_missing_column_is_named(spark, raw_dir):
    (raw_dir / "shop_sellers_dataset.csv").write_text("seller_id\ns1\n")
    with pytest.raises(ValueError, match="seller_state"):
        read_raw(spark, str(raw_dir), "sellers")


def test_a_value_of_another_type_fails_the_load(spark, raw_dir):
    (raw_dir / "shop_order_payments_dataset.csv").write_text(
        "order_id,payment_type,payment_value\no1,boleto,twelve\n"
    )
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        read_raw(spark, str(raw_dir), "order_payments").collect()


def test_load_replaces_and_keeps_every_row(spark, raw_dir, tmp_path):
    folder = str(tmp_path / "tables")
    for _ in range(2):
        load_raw(spark, str(raw_dir), folder)
    tables = StoredMarketplace(spark, folder)
    assert tables.orders.count() == 2
    months = {r["order_id"]: r["order_month"] for r in rows(tables.order_items)}
    assert months == {"o1": date(2018, 2, 1), "stray": None}
    assert tables.geolocation.count() == 1
    assert sorted(p.name for p in Path(folder, "orders").glob("purchase_month=*")) == [
        "purchase_month=2018-02-01",
        "purchase_month=2018-05-01",
    ]
    with pytest.raises(AttributeError):
        _ = tables.refunds


def test_export_writes_nulls_as_a_word(spark, tmp_path):
    export_csv(spark.createDataFrame([("a b", None), ("c", 1)], "name string, n int"), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    with part.open() as file:
        assert list(csv.reader(file)) == [["name", "n"], ["a b", "NULL"], ["c", "1"]]


def test_stored_rows_are_in_the_named_folder(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    assert shared_dir(spark) == str(folder)
    before = set(folder.glob("stored-*"))
    df = stored(spark.range(5))
    assert df.count() == 5
    assert len(set(folder.glob("stored-*")) - before) == 1


def test_report_from_raw_files(spark, raw_dir, tmp_path):
    folder, out = str(tmp_path / "tables"), tmp_path / "out"
    load_raw(spark, str(raw_dir), folder)
    tables = StoredMarketplace(spark, folder)
    shared = Datasets(tables, Params(), keep=stored)
    names = ["j1_1a_late_rate_by_quarter", "j2_5_seller_quarters_filtered", "j3_4_freight_gap", "j3_8_who_pays_freight"]
    write_report(shared, str(out), names)
    for name in names:
        direct = JOBS[name](Datasets(tables, Params()))
        kinds = ", ".join(f"{column} {kind}" for column, kind in direct.dtypes)
        written = spark.read.schema(kinds).option("header", True).option("nullValue", "NULL").csv(f"{out}/{name}")
        assert rows(written) == rows(direct)
    (gap,) = rows(JOBS["j3_4_freight_gap"](shared))
    assert (gap["shipping_type"], gap["total_freight_value"]) == ("Interstate", Decimal("13.29"))
    (paid,) = rows(JOBS["j3_8_who_pays_freight"](shared))
    assert (paid["total_orders"], paid["matched_orders"]) == (1, 1)


def test_repeated_orders_add_no_items(spark, tmp_path):
    """An order id listed twice, also in two months, leaves every item stored once and found by every job."""
    from market import item, market, order, rows

    from bazaarlens.plans.datasets import Datasets
    from bazaarlens.plans.registry import JOBS
    from bazaarlens.sources.warehouse import StoredMarketplace, store_table

    d = market(
        spark,
        orders=[order("a"), order("a"), order("b", "2018-02-10 10:00:00"), order("b", "2018-05-10 10:00:00"), order("c")],
        order_items=[item("a"), item("b"), item("b", 2), item("c"), item("stray")],
    )
    for name in ("orders", "order_items"):
        store_table(getattr(d, name), str(tmp_path), name)
    stored = StoredMarketplace(spark, str(tmp_path))
    assert stored.order_items.count() == 5
    for tables in (d, stored):
        got = {r["purchase_quarter"]: (r["total_orders"], r["total_items"]) for r in rows(JOBS["j3_1_freight_vs_gmv"](Datasets(tables)))}
        assert got == {"2018-Q1": (3, 5), "2018-Q2": (1, 2)}


def test_a_report_leaves_nothing_behind(spark, tmp_path):
    from pathlib import Path

    from bazaarlens.plans.report import run_report
    from bazaarlens.session import shared_dir
    from bazaarlens.sources.star import STAR_PARAMS, StarMarketplace
    from bazaarlens.sources.warehouse import store_table

    star = StarMarketplace(spark, "/root/testdata/sf0.001")
    for name in "orders order_items customers sellers".split():
        store_table(getattr(star, name), str(tmp_path / "tables"), name)
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir()) if shared.exists() else set()
    run_report(spark, str(tmp_path / "tables"), str(tmp_path / "out"), STAR_PARAMS, ["j2_1_dispatch_baseline", "j3_4_freight_gap"])
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"j2_1_dispatch_baseline", "j3_4_freight_gap"}
    assert (set(shared.iterdir()) if shared.exists() else set()) == before


def test_files_are_sorted_by_the_second_date(spark, tmp_path):
    import pyarrow.parquet as pq

    from bazaarlens.sources.star import StarMarketplace
    from bazaarlens.sources.warehouse import store_table

    star = StarMarketplace(spark, "/root/testdata/sf0.001")
    for table, column in (("orders", "order_delivered_customer_date"), ("order_reviews", "review_creation_date")):
        store_table(getattr(star, table), str(tmp_path), table)
        files = list((tmp_path / table).rglob("*.parquet"))
        assert len(files) > 10
        for file in files:
            dates = [d for d in pq.read_table(file, columns=[column], partitioning=None).column(0).to_pylist() if d is not None]
            assert dates == sorted(dates)


def test_reviews_are_rebalanced_after_the_read(spark, tmp_path):
    from bazaarlens.schemas import COLUMN_TYPES
    from bazaarlens.sources.raw_csv import read_raw

    for table, name in (("order_reviews", "x_order_reviews_dataset.csv"), ("orders", "x_orders_dataset.csv")):
        (tmp_path / name).write_text(",".join(COLUMN_TYPES[table]) + "\n")
        plan = read_raw(spark, str(tmp_path), table)._jdf.queryExecution().optimizedPlan().toString()
        assert ("RebalancePartitions" in plan) == (table == "order_reviews"), plan


def test_tables_that_need_nothing_of_each_other_load_side_by_side(spark, raw_dir, tmp_path, monkeypatch):
    """Orders, customers and sellers meet; the facts meet as well, after all others; after a failure they are left alone."""
    from threading import Barrier

    from bazaarlens.schemas import FACT_TABLES
    from bazaarlens.sources import warehouse

    real, done = warehouse.store_table, []
    meet = {t: b for ts in (("orders", "customers", "sellers"), FACT_TABLES) for b in [Barrier(3)] for t in ts}

    def store(df, folder, table, *rest):
        if table in meet:
            meet[table].wait(120)
        real(df, folder, table, *rest)
        done.append(table)

    monkeypatch.setattr(warehouse, "store_table", store)
    folder = str(tmp_path / "tables")
    load_raw(spark, str(raw_dir), folder)
    assert sorted(done) == sorted(RAW_FILES) and set(done[-3:]) == set(FACT_TABLES)
    assert done.index("products") < done.index("category_translation")
    assert StoredMarketplace(spark, folder).order_items.count() == 2

    def failing(df, folder, table, *rest):
        if table == "sellers":
            raise ValueError("sellers")
        done.append(table)

    done.clear()
    monkeypatch.setattr(warehouse, "store_table", failing)
    with pytest.raises(ValueError, match="sellers"):
        load_raw(spark, str(raw_dir), folder)
    assert not set(done) & set(FACT_TABLES)
