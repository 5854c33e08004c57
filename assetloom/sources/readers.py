"""Readers and writers of tables, snapshots and key-value stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assetloom.schemas import schema


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A Parquet table of a known schema."""
    return spark.read.schema(schema(name)).parquet(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """A new snapshot; an existing path is an error, so inputs are never overwritten."""
    df.write.mode("errorifexists").parquet(path)


def decode_sizes(json: Column) -> Column:
    """A stored ``{id: bytes}`` object as a map; corrupt or missing text is an empty map."""
    return F.coalesce(F.from_json(json, "map<string,bigint>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,bigint>"))


def decode_ids(json: Column) -> Column:
    """A stored list of ids; corrupt or missing text is an empty list."""
    return F.coalesce(F.from_json(json, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))


def encode(value: Column) -> Column:
    """The stored form of a list or map."""
    return F.to_json(value)


def stored_date(seconds: Column) -> Column:
    """A stored date, in seconds since 2001-01-01 UTC, as a timestamp."""
    return F.timestamp_seconds(seconds + F.lit(978307200))


def vectors(column: str = "embedding") -> Column:
    """A feature vector; a missing one is empty."""
    return F.coalesce(F.col(column).cast("array<float>"), F.array().cast("array<float>"))
