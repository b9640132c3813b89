"""The stored tables: loading them from raw files, and reading them for the jobs."""

from __future__ import annotations

import argparse
from collections.abc import Iterable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from bazaarlens.functions.periods import COARSE_FACT_COLUMNS, COARSE_ORDER_COLUMNS, month_start
from bazaarlens.operators.numbering import dense_numbers
from bazaarlens.schemas import DATED_TABLES, FACT_TABLES, FACTS_PARTITION, ORDER_KEY, ORDERS_PARTITION
from bazaarlens.session import at_once, build_session, remove_dir, shuffles_dropped
from bazaarlens.sources.bucketed import buckets_of, note_buckets, open_buckets, spreads_evenly, write_buckets
from bazaarlens.sources.labels import ITEM_LABEL, LABELLING, labels_for_items, note_labels, with_labels, without_stale_labels
from bazaarlens.sources.notes import read_note, write_note
from bazaarlens.sources.quarantine import good_rows, put_aside, read_text
from bazaarlens.sources.raw_csv import RAW_FILES, raw_bytes, read_raw
from bazaarlens.sources.versions import current, drop_old, new_version, switch

# Columns by which some jobs choose rows of all months: sorted, most row groups of a file are skipped.
_SORTED = {"orders": "order_delivered_customer_date", "order_reviews": "review_creation_date"}

# A load stores orders and their facts in portions of so many bytes of raw files, but in no more portions than this.
_PORTION_BYTES, _PORTIONS = 256 * 1024**2, 8
_PORTION = "_portion"


def store_table(
    df: DataFrame, warehouse_dir: str, table: str, buckets: int = 0, dated: bool = False, portions: int = 1
) -> None:
    """Replace one stored table; orders must be stored before the tables with several rows per order. Items are
    labelled with their category where products and their translation are stored by then. Text order ids also get
    whole numbers in their order, in all of these tables. With ``dated``, delivered orders and reviews are stored once
    more by the month of their own date, for jobs that choose rows by it.

    Orders and those tables are kept by the month of the purchase, so that a job on two quarters opens six
    directories of each. Rows without a known order, or of an order id listed in several months, are kept in
    a directory of their own, which every job opens. With ``buckets`` (the same number for all) they are also
    stored by bucket of the order id, and joins by order then need no shuffle, unless the ids are uneven.

    With ``portions``, orders and those tables are read once, dealt by order id and then joined and written one portion
    after the other, so that what is shuffled takes the disk of one portion; months have a file or more of each.
    Buckets are written in one go.
    """
    path = f"{warehouse_dir}/{table}"
    df = df.drop(*COARSE_ORDER_COLUMNS, *COARSE_FACT_COLUMNS, ITEM_LABEL, ORDER_KEY)
    if table == "orders" or table in FACT_TABLES:
        if portions > 1 and not buckets:
            _store_dealt(df, warehouse_dir, table, portions)
        else:
            labels = labels_for_items(df.sparkSession, warehouse_dir) if table == "order_items" else None
            placed = _placed(with_labels(df, labels), table, _known_orders(df, warehouse_dir, table))
            _write_by(placed, table, path, buckets)
    else:
        df.write.mode("overwrite").parquet(path)
        if table in LABELLING:
            note_labels(df.sparkSession, warehouse_dir, table)
    if table in DATED_TABLES:
        _store_dated(df, warehouse_dir, table, dated)


def _store_dealt(df: DataFrame, warehouse_dir: str, table: str, portions: int) -> None:
    """Orders or facts, one portion after the other. The rows are stored by portion first, so a value that does not fit
    its type ends the load before the table is touched; a portion goes when it is in the table."""
    spark, folder = df.sparkSession, f"{warehouse_dir}/portions_of_{table}"

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.withColumn(_PORTION, F.pmod(F.xxhash64("order_id"), F.lit(portions)).cast("int"))
        written = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
        written.partitionBy(_PORTION).parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    def only(rows: DataFrame, portion: int) -> DataFrame:
        return rows.filter(F.col(_PORTION) == portion).drop(_PORTION)

    try:
        rows = dealt(df, "rows")
        known = _known_orders(rows, warehouse_dir, table)
        # Ids of another type may be equal and yet hash apart.
        alike = known is not None and known.schema["order_id"].dataType == rows.schema["order_id"].dataType
        known = dealt(known, "orders") if alike else known
        labels = labels_for_items(spark, warehouse_dir) if table == "order_items" else None
        for portion in range(portions):
            of_these = only(known, portion) if alike else known
            placed = _placed(with_labels(only(rows, portion), labels), table, of_these)
            _write_by(placed, table, f"{warehouse_dir}/{table}", more=portion > 0)
            remove_dir(spark, f"{folder}/rows/{_PORTION}={portion}")
    finally:
        remove_dir(spark, folder)


def _known_orders(df: DataFrame, warehouse_dir: str, table: str) -> DataFrame | None:
    """What rows get by their order's id, with one row an id: the order's number, and for facts its month. Nothing for
    orders whose ids are numbers already."""
    spark = df.sparkSession
    if table == "orders":
        if not isinstance(df.schema["order_id"].dataType, StringType):
            return None
        # A table of its own, which also says in one place which number stands for which id.
        keys = dense_numbers(df, "order_id", ORDER_KEY, lambda placed: _kept(placed, f"{warehouse_dir}/order_places"))
        keys = _kept(keys, f"{warehouse_dir}/order_keys")
        remove_dir(spark, f"{warehouse_dir}/order_places")
        return keys
    orders, month = spark.read.parquet(f"{warehouse_dir}/orders"), F.col(ORDERS_PARTITION)
    # One row per order id, also where the raw file repeats one, so that the join adds no rows.
    key = [F.min(ORDER_KEY).alias(ORDER_KEY)] if ORDER_KEY in orders.columns else []
    return orders.groupBy("order_id").agg(*key, F.when(F.min(month) == F.max(month), F.min(month)).alias(FACTS_PARTITION))


def _placed(df: DataFrame, table: str, known: DataFrame | None) -> DataFrame:
    """Rows with the number and the month of their order."""
    if table != "orders":
        return df.join(known, "order_id", "left")
    if known is not None:
        df = df.join(known, "order_id", "left").select(*df.columns, ORDER_KEY)
    return df.withColumn(ORDERS_PARTITION, month_start(F.col("order_purchase_timestamp")))


def _store_dated(df: DataFrame, warehouse_dir: str, table: str, dated: bool) -> None:
    """The second layout of a table, or, where none is wanted, none: a copy of an earlier load must not be read.

    Rows without the date are left out: no range of dates holds them.
    """
    folder, at, month = DATED_TABLES[table]
    spark, path = df.sparkSession, f"{warehouse_dir}/{folder}"
    write_note(spark, warehouse_dir, f"dated_{table}", "")
    if dated:
        known = df.filter(F.col(at).isNotNull()).withColumn(month, month_start(F.col(at)))
        balanced = known.hint("rebalance", F.col(month)).sortWithinPartitions(month, at)
        balanced.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(month).parquet(path)
        write_note(spark, warehouse_dir, f"dated_{table}", "yes")
    else:
        remove_dir(spark, path)


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write_by(df: DataFrame, table: str, path: str, buckets: int = 0, more: bool = False) -> None:
    """Partitioned write, which replaces what is there unless the rows are some ``more`` of the table. The rebalance hint
    sizes the files at run time: a busy month is written by several tasks, quiet ones share a task. Files are
    sorted by a column that jobs filter on besides the month."""
    warehouse_dir, _ = path.rsplit("/", 1)
    partition, sorted_by = ORDERS_PARTITION if table == "orders" else FACTS_PARTITION, _SORTED.get(table)
    bucketed = buckets if buckets and spreads_evenly(df, buckets) else 0
    if not more:
        note_buckets(df.sparkSession, warehouse_dir, table, bucketed)
    if bucketed:
        write_buckets(df, path, partition, bucketed)
        return
    balanced = df.hint("rebalance", F.col(partition))
    if sorted_by and sorted_by in df.columns:
        balanced = balanced.sortWithinPartitions(partition, sorted_by)
    written = balanced.write.mode("append" if more else "overwrite").option("partitionOverwriteMode", "static")
    written.partitionBy(partition).parquet(path)


def load_raw(
    spark: SparkSession,
    raw_dir: str,
    warehouse_dir: str,
    tables: Iterable[str] = tuple(RAW_FILES),
    buckets: int = 0,
    bad_rows: int | None = None,
    dated: bool = False,
) -> None:
    """Full refresh of the tables (all nine unless named) from the raw files.

    Tables with several rows per order come last: they take months from orders, and items labels from products, and
    are not touched if another table fails. Otherwise tables are loaded side by side, but for products and their
    translation, which note their labels together. The first bad value ends the load, unless ``bad_rows`` says how many rows of a table may be put aside under
    ``quarantine``; that reads the files once more.

    Large tables are stored in portions, and what was shuffled goes with each job, so that the disk wanted besides the
    tables is a fraction of what all rows take when shuffled.
    """

    def load(*tables: str) -> None:
        for table in tables:
            if bad_rows is None:
                rows = read_raw(spark, raw_dir, table)
            else:
                text = read_text(spark, raw_dir, table)
                put_aside(text, warehouse_dir, table, bad_rows)
                rows = good_rows(text, table)
            portions = min(_PORTIONS, 1 + raw_bytes(spark, raw_dir, table) // _PORTION_BYTES)
            store_table(rows, warehouse_dir, table, buckets, dated, portions)

    wanted = list(tables)
    alone = [t for t in wanted if t not in FACT_TABLES and t not in LABELLING]
    # Orders take longest of the first, so they start first.
    first = [(t,) for t in sorted(alone, key="orders".__ne__)] + [tuple(t for t in wanted if t in LABELLING)]
    with shuffles_dropped(spark):
        for groups in (first, [(t,) for t in wanted if t in FACT_TABLES]):
            at_once(spark, [partial(load, *group) for group in groups])


def refresh(
    spark: SparkSession,
    raw_dir: str,
    warehouse_dir: str,
    buckets: int = 0,
    bad_rows: int | None = None,
    dated: bool = False,
    keep: int = 2,
) -> str:
    """Load all tables as a new version beside the old one, then switch to it; returns its folder.

    Until the switch, and after a load that failed, readers find the old tables. Of the versions the last
    ``keep`` stay.
    """
    version = new_version(warehouse_dir)
    load_raw(spark, raw_dir, version, buckets=buckets, bad_rows=bad_rows, dated=dated)
    switch(spark, warehouse_dir, version)
    drop_old(spark, warehouse_dir, keep)
    return version


class StoredMarketplace:
    """The stored tables, each opened when first asked for, all of the version that counts when this is made."""

    def __init__(self, spark: SparkSession, warehouse_dir: str) -> None:
        self._spark = spark
        self._dir = current(spark, warehouse_dir)
        self._by_date: dict[str, DataFrame | None] = {}

    def __getattr__(self, table: str) -> DataFrame:
        if table not in RAW_FILES:
            raise AttributeError(table)
        path, buckets = f"{self._dir}/{table}", 0
        partition = ORDERS_PARTITION if table == "orders" else FACTS_PARTITION if table in FACT_TABLES else None
        if partition:
            buckets = buckets_of(self._spark, self._dir, table)
        df = open_buckets(self._spark, path, partition, buckets) if buckets else self._spark.read.parquet(path)
        if table == "order_items":
            df = without_stale_labels(df, self._dir)
        setattr(self, table, df)
        return df


    def by_own_date(self, table: str) -> DataFrame | None:
        """Delivered orders or reviews as stored by the month of their own date, if they are."""
        if table not in self._by_date:
            folder, *_ = DATED_TABLES[table]
            there = read_note(self._spark, self._dir, f"dated_{table}")
            self._by_date[table] = self._spark.read.parquet(f"{self._dir}/{folder}") if there else None
        return self._by_date[table]


def main() -> None:
    parser = argparse.ArgumentParser(description="Load the raw CSV files into Parquet tables.")
    parser.add_argument("raw_dir")
    parser.add_argument("warehouse_dir")
    parser.add_argument("--shuffle-gb", type=int, help="size of the largest shuffle expected")
    parser.add_argument("--buckets", type=int, default=0, help="store orders and their facts in so many buckets")
    parser.add_argument("--bad-rows", type=int, help="rows of a table that may be put aside; none unless given")
    parser.add_argument("--versions", type=int, default=0, help="load beside the old tables, and keep so many versions")
    parser.add_argument("--dated", action="store_true", help="store orders and reviews by their own date as well")
    args = parser.parse_args()
    spark = build_session("bazaarlens-load", shuffle_gb=args.shuffle_gb)
    options = {"buckets": args.buckets, "bad_rows": args.bad_rows, "dated": args.dated}
    if args.versions:
        refresh(spark, args.raw_dir, args.warehouse_dir, keep=args.versions, **options)
    else:
        load_raw(spark, args.raw_dir, args.warehouse_dir, **options)


if __name__ == "__main__":
    main()
