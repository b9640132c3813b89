"""Connected components of a graph given as links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.shared import stored


def _large_star(links: DataFrame, path: tuple[str, str]) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = stored(least, *path)
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame, path: tuple[str, str]) -> DataFrame:
    least = stored(links.groupBy("u").agg(F.min("v").alias("m")), *path)
    moved = links.join(least, "u").filter(F.col("v") != F.col("m"))
    moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, folder: str) -> DataFrame:
    """Columns u, root: for every node of ``links`` (u, v) that is not the smallest of its component, which is.

    Alternates the large-star and small-star steps until every node hangs from its component's smallest; the
    number of rounds grows with the logarithm of a component's size. Links are kept from the larger to the
    smaller node. A node with very many links sends one row per map task into its minimum. The minima and
    each step are stored tables, so a join reads both sides straight from a shuffle and adaptive execution splits
    such a node.
    """
    ends = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    table = stored(ends.filter(F.col("u") != F.col("v")).distinct(), folder, "links0")

    def mark_of(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    mark = mark_of(table)
    for turn in range(1, 100):
        large = stored(_large_star(table, (folder, f"least{turn}a")), folder, f"large{turn}")
        table = stored(_small_star(large, (folder, f"least{turn}b")), folder, f"links{turn}")
        before, mark = mark, mark_of(table)
        if mark == before:
            return table.withColumnRenamed("v", "root")
    raise RuntimeError("components did not settle")
