"""Bringing tables with several rows per key to one row per key.

Each operator combines rows before they are shuffled, so a key holding a large part of the table sends only
a row or a few per map task, never its whole group, to one reducer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DateType, IntegerType, LongType, ShortType, TimestampNTZType, TimestampType


def conditional_metrics(
    df: DataFrame, keys: Sequence[str | Column], metrics: Mapping[str, Column]
) -> DataFrame:
    """One row per key with the named totals: counts, sums and means, conditional or not, in one pass."""
    return df.groupBy(*keys).agg(*(value.alias(name) for name, value in metrics.items()))


def distinct_pairs(df: DataFrame, *columns: str) -> DataFrame:
    """Each combination once, so that a join on part of it cannot count a row twice."""
    return df.select(*columns).distinct()


def distinct_count(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Different values of a column per key, NULL not counted.

    Pairs are made distinct first and then counted, so neither step holds a key's values in one place, and a
    pair that repeats is one row per task before the shuffle.
    """
    pairs = distinct_pairs(df, *keys, column)
    return conditional_metrics(pairs, keys, {name: F.count(column)})


def min_support(df: DataFrame, column: str, least: int) -> DataFrame:
    """Drop groups too small for their rate to mean anything."""
    return df.filter(F.col(column) >= least)


def main_record(df: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """First row of each group in the given order, which should leave no ties.

    Filtering ``row_number`` to 1 lets Spark keep one candidate per group and map task before the shuffle
    (``WindowGroupLimit``), so a huge group is reduced where it lies.
    """
    position = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.withColumn("_position", position).filter(F.col("_position") == 1).drop("_position")


# A time in microseconds times this, and a whole-number id above zero, fit one DECIMAL(38,0).
_ID_SPACE = 1 << 65
_WHOLE = (ByteType, ShortType, IntegerType, LongType)


def _micros(df: DataFrame, at: str) -> Column | None:
    """A time as whole microseconds, or None for a column that is none."""
    kind, value = df.schema[at].dataType, F.col(at)
    days = F.unix_date(F.to_date(value)).cast("long") * 86_400_000_000
    if isinstance(kind, DateType):
        return days
    if isinstance(kind, TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, TimestampNTZType):
        seconds = (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("long")
        return days + (F.hour(value) * 60 + F.minute(value)).cast("long") * 60_000_000 + seconds
    return None


def first_record_with_total(
    records: DataFrame, owner: str, at: str, record: str, total: str = "total_orders"
) -> DataFrame:
    """Per owner: the earliest record (ties: lowest id), its time, and how many records there are.

    An aggregate rather than a window over each owner's rows: partial results are combined before the
    shuffle, so the number of rows one owner has does not matter. A record without a time comes first, and of these
    one without an id. Whole-number ids are packed with the time into one decimal, whose minimum Spark keeps in a
    hash table; for a text id it has to sort.
    """
    micros = _micros(records, at)
    if micros is None or not isinstance(records.schema[record].dataType, _WHOLE):
        earliest = F.min(F.struct(at, record))
        return (
            records.groupBy(owner)
            .agg(earliest.alias("_first"), F.count(F.lit(1)).alias(total))
            .select(owner, F.col(f"_first.{record}"), F.col(f"_first.{at}"), total)
        )
    wide, space = "decimal(20,0)", F.lit(Decimal(_ID_SPACE))
    above = F.lit(Decimal((1 << 63) + 1))
    # No time has -10^17 microseconds: that is 3,000 years before the first year.
    time = F.coalesce(micros, F.lit(-(10**17))).cast("decimal(18,0)")
    numbered = F.coalesce(F.col(record).cast(wide) + above, F.lit(Decimal(0)))
    packed = (time * space).cast("decimal(38,0)") + numbered
    found = records.groupBy(owner).agg(
        F.min(packed.cast("decimal(38,0)")).alias("_first"),
        F.min(at).alias("_at"),
        F.count(at).alias("_timed"),
        F.count(F.lit(1)).alias(total),
    )
    number = F.pmod(F.col("_first"), space)
    return found.select(
        owner,
        F.when(number > 0, number - above).cast(records.schema[record].dataType).alias(record),
        F.when(F.col("_timed") == F.col(total), F.col("_at")).alias(at),
        total,
    )


def numbered_records(
    records: DataFrame,
    owner: str,
    at: str,
    record: str,
    number: str = "order_no",
    total: str = "total_orders",
) -> DataFrame:
    """All records with their position in time within the owner, and the owner's total.

    Equal to ``row_number`` and ``count`` over the owner, but an owner's rows are never gathered in one
    task: rows are numbered within (owner, day), and the owner's earlier days, already counted, are added.
    The per-owner window then runs over days, whose number the calendar bounds. Both halves, and the join
    back, use the same shuffle by (owner, day). The keys are structs, which are equal also where their field
    is NULL.
    """
    day = W.partitionBy("_owner", "_day")
    numbered = (
        records.withColumn("_owner", F.struct(owner))
        .withColumn("_day", F.struct(F.to_date(at)))
        .withColumn("_position", F.row_number().over(day.orderBy(at, record)))
        .withColumn("_n", F.count(F.lit(1)).over(day))
        .drop(owner)
    )
    owners = W.partitionBy("_owner")
    earlier = owners.orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    per_day = numbered.filter(F.col("_position") == F.col("_n")).select(
        "_owner",
        "_day",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("bigint")).alias("_before"),
        F.sum("_n").over(owners).alias(total),
    )
    kept = (F.col(f"_owner.{owner}") if name == owner else F.col(name) for name in records.columns)
    return numbered.join(per_day, ["_owner", "_day"]).select(
        *kept, (F.col("_before") + F.col("_position")).alias(number), total
    )
