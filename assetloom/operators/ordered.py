"""Running sums and previous rows in an order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assetloom.storage import Scratch

#: Rows that are ordered in one task; more are cut into ranges of about so many.
RANGE_ROWS = 100_000


def in_ranges(frame: DataFrame, scratch: Scratch, order: list[Column], rows: int = RANGE_ROWS) -> DataFrame:
    """``frame`` stored with ``_part``, the range of the order that a row is in."""
    parts = max(1, -(-frame.count() // rows))
    ranged = frame.repartitionByRange(parts, *order) if parts > 1 else frame.coalesce(1)
    return scratch.save(ranged.withColumn("_part", F.spark_partition_id()), "ranges")


def running_sums(frame: DataFrame, scratch: Scratch, order: list[Column], rows: int = RANGE_ROWS, **sums: Column) -> DataFrame:
    """``frame`` with running sums, the row's own included.

    Sums of whole ranges, one row for each, give a range its offset; a window
    inside the range does the rest.
    """
    ranged = in_ranges(frame, scratch, order, rows)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    offsets = totals.select(F.col("_part").alias("_of"), *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranged.join(offsets, F.col("_part") == F.col("_of"))
    return inside.select(*frame.columns, *[(F.sum(c).over(upto) + F.col(f"_{k}")).alias(k) for k, c in sums.items()])


def with_previous(frame: DataFrame, scratch: Scratch, order: list[str], values: list[str], name: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``frame`` with a struct of the previous row's values; null for the first row.

    The last row of the range before serves the first row of a range.
    """
    ranged = in_ranges(frame, scratch, [F.col(c) for c in order], rows)
    kept = F.struct(*values)
    last = ranged.groupBy("_part").agg(F.max(F.struct(*order, kept.alias("_kept")))["_kept"].alias("_last"))
    carried = last.select(F.col("_part").alias("_of"), F.lag("_last").over(Window.orderBy("_part")).alias("_carried"))
    inside = Window.partitionBy("_part").orderBy(*order)
    out = ranged.join(carried, F.col("_part") == F.col("_of"))
    return out.select(*frame.columns, F.coalesce(F.lag(kept).over(inside), F.col("_carried")).alias(name))
