"""Sums and rounded metrics.

Money is summed as whole cents in a BIGINT: exact like a decimal sum, at half its cost per row, and an
overflow raises an error. Ratios divide exact decimals and round once, half away from zero; a zero
denominator gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_COUNT = "decimal(20,0)"
_RESULT = "decimal(20,2)"


def ratio(numerator: Column, denominator: Column, factor: int = 1) -> Column:
    """``round(factor * numerator / denominator, 2)`` of two decimals."""
    scaled = numerator if factor == 1 else F.lit(factor) * numerator
    return F.round(F.try_divide(scaled, denominator), 2).cast(_RESULT)


def pct(part: Column, whole: Column) -> Column:
    """Percentage of two counts."""
    return ratio(part.cast(_COUNT), whole.cast(_COUNT), 100)


def per_100(part_cents: Column, whole_cents: Column) -> Column:
    """Amount per 100 of another amount: a ratio of sums, not a mean of ratios."""
    return pct(part_cents, whole_cents)


def cents(value: Column) -> Column:
    """Money with two decimals as whole cents."""
    return (value * 100).cast("bigint")


def amount(total_cents: Column) -> Column:
    """A sum of cents as money."""
    return (total_cents.cast(_COUNT) / 100).cast(_RESULT)


def mean_of(total: Column, n: Column) -> Column:
    """Mean from an exact sum (decimal, or whole number) and a count."""
    return ratio(total.cast("decimal(28,4)"), n.cast(_COUNT))


def mean_amount(total_cents: Column, n: Column) -> Column:
    """Mean money from a sum of cents and a count."""
    return ratio(total_cents.cast(_COUNT), n.cast(_COUNT) * 100)


def mean(value: Column) -> Column:
    """Mean of the non-NULL values of a whole-number or decimal column with at most 4 decimals."""
    return mean_of(F.sum(value), F.count(value))


def scaled(value: Column) -> Column:
    """A decimal of at most 4 decimals as a whole number of ten-thousandths, which sums as a long."""
    return (value * 10_000).cast("bigint")


def mean_of_scaled(total: Column, n: Column) -> Column:
    """Mean from a sum of ten-thousandths and a count."""
    return ratio(total.cast("decimal(28,0)"), n.cast(_COUNT) * 10_000)


def count_where(condition: Column) -> Column:
    """Rows where the condition holds (a NULL condition does not); 0 for none."""
    return F.count_if(condition)


def total_where(condition: Column) -> Column:
    """As :func:`count_where`, but NULL over no rows at all, which a keyless aggregate can meet."""
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0)))


def sum_where(condition: Column, value: Column) -> Column:
    """Sum of a whole number over the rows where the condition holds; other rows add 0."""
    return F.sum(F.when(condition, value).otherwise(F.lit(0)))
