"""The driver's tables as media-library tables of the same shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

OPS = {"click": "keep", "purchase": "mark", "view": "spare", "error": "clear", "signup": "forget"}
MEDIA = {"F": "image", "O": "video", "P": "other"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asset_id(column: str) -> Column:
    """The carrier's key as an asset id. Ids are of any ordered type; the carriers' are whole numbers."""
    return F.col(column).alias("asset_id")


def _mapped(column: str, values: dict[str, str]):
    out = F.lit(None).cast("string")
    for key, value in reversed(values.items()):
        out = F.when(F.col(column) == key, value).otherwise(out)
    return out


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(
        asset_id("o_orderkey"), F.col("o_orderdate").alias("creation_date"), _mapped("o_orderstatus", MEDIA).alias("media_type")
    )


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(asset_id("l_orderkey"), F.col("l_quantity").cast("bigint").alias("file_size"))


def albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("album_id"), F.col("c_name").alias("title"))


def album_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("album_id"), asset_id("o_orderkey"))


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), asset_id("user_id"), _mapped("event_type", OPS).alias("op")
    )


def decision_log_with_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log where the error of the least value is a reset of everything."""
    events = _table(spark, sf_dir, "events")
    lowest = events.where("event_type = 'error'").agg(F.min("value")).scalar()
    reset = (F.col("event_type") == "error") & (F.col("value") == lowest)
    return events.select(
        F.col("event_id").alias("seq"), F.when(~reset, asset_id("user_id")).alias("asset_id"), F.when(reset, "reset").otherwise(_mapped("event_type", OPS)).alias("op")
    )


def delete_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        F.col("event_id").alias("seq"), F.col("ts").alias("date"), F.lit(1).cast("bigint").alias("count"), F.floor("value").cast("bigint").alias("bytes_freed")
    )


def feature_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors; the oldest-first order is that of the ids, the quality is the label."""
    return _table(spark, sf_dir, "embeddings").select(
        asset_id("vec_id"), F.col("embedding"), F.col("label").cast("bigint").alias("quality"), F.col("vec_id").alias("age")
    )


def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(asset_id("doc_id"), F.col("text").alias("burst_id"))
