"""Rounding, clipping and one-row attachment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_even(value: Column, digits: int | None) -> Column:
    """Round half to even on the binary value; ``None`` leaves the value alone."""
    if digits is None:
        return value
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def as_count(condition: Column) -> Column:
    """Number of rows where the condition holds, as a long; null counts as false."""
    return F.count(F.when(condition, F.lit(1)))


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))


def with_one_row(df: DataFrame, one_row: DataFrame, prefix: str = "") -> DataFrame:
    """Attach the columns of a one-row aggregate to every row.

    The aggregate becomes a scalar subquery: Spark runs it once and hands every task one struct,
    so the big side is neither shuffled nor joined.
    """
    names = one_row.columns
    packed = one_row.select(F.struct(*[F.col(n) for n in names]).alias("one")).scalar()
    return df.withColumn("_one", packed).select(
        *[F.col(c) for c in df.columns],
        *[F.col("_one").getField(n).alias(prefix + n) for n in names],
    )
