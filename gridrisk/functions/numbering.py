"""Consecutive numbers in an order of the whole table, without a window over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrisk.session import scratch_path
from gridrisk.sources.writers import write_table

#: Bits of monotonically_increasing_id that count rows inside a partition.
ROW_BITS = 33


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with ``name``: 1, 2, … in the given order, which should be total.

    Rows are range-partitioned and sorted inside partitions; a partition's numbers start after the
    rows of those before it. The only window is over one row a partition. The numbered rows are
    written first, so that a task that runs again cannot number them otherwise.
    """
    spark = df.sparkSession
    place = F.monotonically_increasing_id()
    rows = write_table(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place), scratch_path(spark, "numbered")
    )
    part = F.shiftright("_place", ROW_BITS).alias("_part")
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_begin"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        rows.withColumn("_part", part)
        .join(begins, "_part")
        .withColumn(name, F.col("_begin") + inside + 1)
        .drop("_part", "_place", "_begin")
    )
