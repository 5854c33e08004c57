"""The log of deletions and its totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assetloom.operators.ordered import RANGE_ROWS, running_sums
from assetloom.storage import Scratch


def totals(log: DataFrame) -> DataFrame:
    """One row: photos deleted and bytes freed; zeros for an empty log."""
    return log.agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("photos"), F.coalesce(F.sum("bytes_freed"), F.lit(0)).cast("bigint").alias("bytes")
    )


def with_running_total(log: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The log with the bytes freed so far, newest first; ranges of equal size, whatever the numbers, share the work."""
    scratch = Scratch(log.sparkSession, "activity")
    out = running_sums(log, scratch, [F.col("seq")], range_rows, total_bytes=F.col("bytes_freed"))
    return out.withColumn("total_bytes", F.col("total_bytes").cast("bigint")).orderBy(F.desc("seq"))
