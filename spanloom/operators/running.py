"""Running sums over an order that no task holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.checkpoint import cut


def in_ranges(rows: DataFrame, order: str, block_rows: int = 1_000_000) -> DataFrame:
    """``rows`` with ``range``, the number of a stretch of ``order`` of about ``block_rows`` rows.

    Stretches are bounded by quantiles of a sample that Spark takes, so that outlying values
    do not put the other rows into one; they are fixed in the checkpoint folder.
    """
    n = rows.count()
    return cut(rows.repartitionByRange(1 + n // block_rows, order)).withColumn("range", F.spark_partition_id())


def running_totals(rows: DataFrame, group: str, order: str, size: str, block_rows: int = 1_000_000) -> DataFrame:
    """``rows`` with ``used``, the sum of ``size`` of the group's earlier rows, and ``nth``, from 1.

    Sums run inside ranges of ``order``, and the ranges' totals are summed before them, so
    that a large group is dealt over many tasks.
    """
    rows = in_ranges(rows, order, block_rows)
    per = rows.groupBy(group, "range").agg(F.sum(size).alias("t"), F.count("*").alias("c"))
    earlier = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(
        F.col(group).alias("base_group"), F.col("range").alias("base_range"),
        F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c"),
    )
    inside = Window.partitionBy(group, "range").orderBy(order)
    used = F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("used", used).withColumn("nth", F.row_number().over(inside))
    rows = rows.join(base, F.col(group).eqNullSafe(F.col("base_group")) & (F.col("range") == F.col("base_range")))
    return rows.withColumn("used", F.col("used") + F.col("t")).withColumn("nth", F.col("nth") + F.col("c")).drop("range", "base_group", "base_range", "t", "c")
