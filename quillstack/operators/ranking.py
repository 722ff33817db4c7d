"""Ranks over a whole table, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with the place (from 0) of each row in ``order``, which must leave no ties.

    Rows are cut into ranges and sorted within; the sizes of the ranges, one row each, give where each
    begins. The sorted table is written, since the ranges must be the same ones when they are counted.
    """
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(cut.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    # the upper bits of the id are the range, the lower 33 the place within it
    part = F.shiftright("_id", 33)
    inner = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).count()
    starts = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_start"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + inner).drop("_id", "_part", "_start")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows with rank (from 1); a limit before the window keeps what is gathered to ``n`` rows."""
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def running(df: DataFrame, value: str, name: str, *order: Column) -> DataFrame:
    """The running sum of ``value`` over few rows, as ``top`` gives them."""
    return df.withColumn(name, F.sum(value).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
