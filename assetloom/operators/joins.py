"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rows of a key beyond which they are dealt to several parts.
HOT = 512
#: Hot keys up to this number may be broadcast (16 bytes each); beyond it every key has ``SALTS`` parts.
BROADCAST_KEYS, SALTS = 500_000, 16


def split_join(left: DataFrame, right: DataFrame, key: str, by: str, hot: int = HOT, most: int = BROADCAST_KEYS) -> DataFrame:
    """Joins each row with its key's only row in ``right``, where ``c`` is the key's number of rows.

    Keys with more than ``hot`` rows are dealt to parts by the column ``by``,
    so that none fills a task. ``right`` should be a stored table, since it is
    read more than once. ``salt`` is the part.
    """
    large = right.where(F.col("c") > hot).select(F.col(key).alias("_hot"), parts_of(F.col("c"), hot).alias("_parts"))
    n = large.count()
    parts, given = F.lit(1), left
    if n > most:
        parts = F.lit(SALTS)
    elif n:
        given, parts = left.join(F.broadcast(large), F.col(key) == F.col("_hot"), "left"), F.coalesce("_parts", F.lit(1))
    given = given.withColumn("salt", F.pmod(F.xxhash64(by), parts).cast("int")).select(*left.columns, "salt")
    last = (F.lit(SALTS) if n > most else parts_of(F.col("c"), hot)) - 1
    spread = right.withColumn("salt", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return given.join(spread, [key, "salt"])


def parts_of(rows: Column, hot: int) -> Column:
    return F.when(rows > hot, F.ceil(rows / hot)).otherwise(F.lit(1)).cast("int")
