"""Sizes of assets from their resources, and the size cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def asset_sizes(assets: DataFrame, resources: DataFrame) -> DataFrame:
    """``asset_id, bytes`` of every asset; 0 without resources or readable sizes."""
    sums = resources.groupBy("asset_id").agg(F.sum("file_size").alias("bytes"))
    return assets.select("asset_id").join(sums, "asset_id", "left").select("asset_id", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))


def total_size(resources: DataFrame, ids: DataFrame) -> DataFrame:
    """One row with the bytes of the given assets; 0 for none."""
    wanted = resources.join(ids.select("asset_id").distinct(), "asset_id", "left_semi")
    return wanted.agg(F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("bytes"))


def cache_misses(assets: DataFrame, cache: DataFrame) -> DataFrame:
    return assets.select("asset_id").join(cache.select("asset_id"), "asset_id", "left_anti")


def merge_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new sizes put in; new ones win, nothing is evicted."""
    old = cache.select("asset_id", F.col("bytes").alias("old"))
    return old.join(new.select("asset_id", F.col("bytes").alias("new")), "asset_id", "full").select("asset_id", F.coalesce("new", "old").alias("bytes"))
