"""The category label stored with each item, so that no job moves items by product only to name their category.

The labels belong to products and their translation. Both tables' labels have a fingerprint; items note the one they
were labelled from. Where the two differ, because products were loaded again and items were not, the stored
labels are left aside and jobs look products up as without them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.operators.lookup import category_label
from bazaarlens.sources.notes import read_note, write_note

ITEM_LABEL = "item_category"
LABELLING = ("products", "category_translation")
_CURRENT, _USED = "labels", "labels_of_items"


def _labels(spark: SparkSession, warehouse_dir: str) -> DataFrame:
    products, names = (spark.read.parquet(f"{warehouse_dir}/{table}") for table in LABELLING)
    return category_label(products, names).select("product_id", "category_name")


def note_labels(spark: SparkSession, warehouse_dir: str, table: str) -> None:
    """After products or their translation were stored: note the fingerprint of the labels they give together.

    It is empty where a product has several rows, as an item could then have several labels.
    """
    write_note(spark, warehouse_dir, f"has_{table}", "yes")
    if not all(read_note(spark, warehouse_dir, f"has_{name}") for name in LABELLING):
        return
    by_product = _labels(spark, warehouse_dir).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("product_id", "category_name").cast("decimal(38,0)")).alias("h"))
    most, rows, total = by_product.agg(F.max("n"), F.sum("n"), F.sum("h")).first()
    write_note(spark, warehouse_dir, _CURRENT, "" if most is None or most > 1 else f"{rows} {total}")


def labels_for_items(spark: SparkSession, warehouse_dir: str) -> DataFrame | None:
    """The labels that items are about to get, of which a note is made; None where no labels are stored yet."""
    current = read_note(spark, warehouse_dir, _CURRENT)
    write_note(spark, warehouse_dir, _USED, current or "")
    return _labels(spark, warehouse_dir).withColumnRenamed("category_name", ITEM_LABEL) if current else None


def with_labels(items: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Items with the label of their product, NULL where it is not known; unchanged without labels."""
    if labels is None:
        return items
    return items.join(labels, "product_id", "left").select(*items.columns, ITEM_LABEL)


def without_stale_labels(items: DataFrame, warehouse_dir: str) -> DataFrame:
    spark = items.sparkSession
    if ITEM_LABEL not in items.columns:
        return items
    used = read_note(spark, warehouse_dir, _USED)
    return items if used and used == read_note(spark, warehouse_dir, _CURRENT) else items.drop(ITEM_LABEL)
