"""Day sections and album summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from assetloom.functions.scalars import start_of_day


def day_sections(assets: DataFrame, date: str = "creation_date") -> DataFrame:
    """``day, asset_ids, n``: newest day first, newest asset first; undated assets are dropped.

    A section holds all ids of its day, as the screen shows it. Where days are
    unbounded, ``day_rows`` is the same relation without the arrays.
    """
    newest = lambda a, b: F.when(a["at"] > b["at"], -1).when(a["at"] < b["at"], 1).when(a["asset_id"] < b["asset_id"], -1).when(a["asset_id"] > b["asset_id"], 1).otherwise(0)
    rows = day_rows(assets, date)
    grouped = rows.groupBy("day").agg(F.array_sort(F.collect_list(F.struct(F.col(date).alias("at"), "asset_id")), newest).alias("members"))
    return grouped.select("day", F.col("members.asset_id").alias("asset_ids"), F.size("members").alias("n")).orderBy(F.desc("day"))


def day_rows(assets: DataFrame, date: str = "creation_date") -> DataFrame:
    """Each dated asset with its day."""
    return assets.where(F.col(date).isNotNull()).select(start_of_day(F.col(date)).alias("day"), date, "asset_id")


def day_counts(assets: DataFrame, date: str = "creation_date") -> DataFrame:
    """``day, n``, the newest day first."""
    return day_rows(assets, date).groupBy("day").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day"))


def album_summaries(albums: DataFrame, album_assets: DataFrame, assets: DataFrame) -> DataFrame:
    """``album_id, title, n, cover_id`` of the albums with images, by title.

    The cover is the newest image, the smallest id among equals. Albums
    without a title come first and are shown as "Untitled".
    """
    images = assets.where("media_type = 'image'").select("asset_id", "creation_date")
    members = album_assets.join(images, "asset_id")
    newest = Window.partitionBy("album_id").orderBy(F.col("creation_date").desc_nulls_last(), "asset_id")
    # the rank is cut to one before and after the shuffle, so no task sorts a whole album
    covers = members.withColumn("place", F.row_number().over(newest)).where("place = 1").select("album_id", F.col("asset_id").alias("cover_id"))
    counts = members.groupBy("album_id").agg(F.count(F.lit(1)).alias("n"))
    out = albums.join(counts, "album_id").join(covers, "album_id").orderBy(F.col("title").asc_nulls_first(), "album_id")
    return out.select("album_id", F.coalesce("title", F.lit("Untitled")).alias("title"), "n", "cover_id")
