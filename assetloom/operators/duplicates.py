"""Duplicate groups: bursts and similar vectors, their components and keepers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from assetloom.operators.components import connected_components
from assetloom.operators.joins import split_join
from assetloom.operators.similarity import similar_pairs
from assetloom.storage import Scratch


def burst_edges(index: DataFrame, bursts: DataFrame) -> DataFrame:
    """A star of edges per burst among indexed assets: ``a`` is the smallest id, ``b`` another.

    Null bursts are none; an empty string is a burst like any other.
    """
    members = bursts.where(F.col("burst_id").isNotNull()).join(index.select("asset_id"), "asset_id", "left_semi")
    members = members.select("asset_id", F.sha2("burst_id", 256).alias("burst"))
    centres = members.groupBy("burst").agg(F.min("asset_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return members.join(centres, "burst").where("asset_id <> a").select("a", F.col("asset_id").alias("b"))


def all_edges(index: DataFrame, threshold: float, bursts: DataFrame | None = None) -> DataFrame:
    edges = similar_pairs(index, threshold)
    return edges if bursts is None else edges.unionByName(burst_edges(index, bursts))


def members(index: DataFrame, edges: DataFrame) -> DataFrame:
    """``component, c, keeper_id, asset_id, quality, age`` of the assets in components of two or more.

    ``index`` has ``quality`` and ``age``. The keeper is the member of most
    quality, the oldest among equals (unknown age before all), and names the
    group. One row for each member, whatever the size of its group.
    """
    scratch = Scratch(edges.sparkSession, "members")
    comps = connected_components(edges, "a", "b").select(F.col("node").alias("asset_id"), "component")
    rows = scratch.save(index.select("asset_id", "quality", "age").join(comps, "asset_id"), "rows")
    best = F.min(F.struct((-F.coalesce("quality", F.lit(0))).alias("neg"), F.col("age").isNotNull().alias("dated"), "age", "asset_id"))
    keepers = rows.groupBy("component").agg(F.count(F.lit(1)).alias("c"), best["asset_id"].alias("keeper_id")).where("c > 1")
    return split_join(rows, scratch.save(keepers, "keepers"), "component", "asset_id").drop("salt")


def groups_from_edges(index: DataFrame, edges: DataFrame) -> DataFrame:
    """``group_id, asset_ids, keeper_id, n``: components of two or more.

    Members come oldest first (unknown age before all). The arrays hold whole
    groups, as a screen shows them; ``group_members`` has the same without.
    """
    member = F.struct(F.col("age").isNotNull().alias("dated"), "age", "asset_id")
    grouped = members(index, edges).groupBy("component").agg(F.array_sort(F.collect_list(member)).alias("m"), F.first("keeper_id").alias("keeper_id"))
    out = grouped.select(F.col("keeper_id").alias("group_id"), F.col("m.asset_id").alias("asset_ids"), "keeper_id", F.size("m").alias("n"))
    return out.orderBy(F.desc("n"), F.desc("group_id"))


def duplicate_groups(index: DataFrame, threshold: float, bursts: DataFrame | None = None) -> DataFrame:
    return groups_from_edges(index, all_edges(index, threshold, bursts))


def group_previews(rows: DataFrame, size: int = 8) -> DataFrame:
    """The keeper and the first others of each group, from ``members``; arrays hold ``size`` ids at most."""
    keeper = F.col("asset_id") == F.col("keeper_id")
    order = Window.partitionBy("component").orderBy((~keeper), F.col("age").isNotNull(), "age", "asset_id")
    front = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    listed = front.groupBy("component").agg(F.first("keeper_id").alias("group_id"), F.array_sort(F.collect_list(F.struct("place", "asset_id"))).alias("m"))
    return listed.select("group_id", F.col("m.asset_id").alias("preview"))


def group_members(rows: DataFrame) -> DataFrame:
    """``group_id, asset_id, is_keeper`` of every member, from ``members``."""
    return rows.select(F.col("keeper_id").alias("group_id"), "asset_id", (F.col("asset_id") == F.col("keeper_id")).alias("is_keeper"))


def group_sizes(rows: DataFrame) -> DataFrame:
    """``group_id, keeper_id, n`` of each group, the largest first, from ``members``."""
    keepers = rows.where(F.col("asset_id") == F.col("keeper_id"))
    return keepers.select(F.col("keeper_id").alias("group_id"), "keeper_id", F.col("c").alias("n")).orderBy(F.desc("n"), F.desc("group_id"))
