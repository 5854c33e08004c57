"""The feature index: what to scan, and its refresh as a new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def pending(assets: DataFrame, index: DataFrame) -> DataFrame:
    """Assets without an index row; edits of indexed assets are not noticed."""
    return assets.join(index.select("asset_id"), "asset_id", "left_anti")


def indexed(assets: DataFrame, index: DataFrame) -> DataFrame:
    return assets.join(index.select("asset_id"), "asset_id", "left_semi")


def upsert(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index with the rows put in; a row replaces that of its id."""
    return index.join(rows.select("asset_id"), "asset_id", "left_anti").unionByName(rows)


def purge(index: DataFrame, library: DataFrame) -> DataFrame:
    """The index without assets that left the library."""
    return index.join(library.select("asset_id"), "asset_id", "left_semi")


def refresh(index: DataFrame, rows: DataFrame, library: DataFrame) -> DataFrame:
    """Upsert, then purge."""
    return purge(upsert(index, rows), library)


def has_index(index: DataFrame) -> bool:
    return not index.isEmpty()


def point(index: DataFrame, asset_id) -> DataFrame:
    """The row of one asset, if there is one; the key reaches the scan."""
    return index.where(F.col("asset_id") == asset_id)


def exists(index: DataFrame) -> DataFrame:
    """One row: whether the index has any."""
    return index.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_index"))


def row_count(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("n"))
