"""Decks: declarative scans of the library, compiled to one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

MEDIA = {"photos": "image", "videos": "video", "all": None}
ORDERS = ("chronological", "largest_first")


@dataclass(frozen=True)
class DeckSpec:
    """What a deck shows.

    ``album_id`` limits it to an album; ``ids`` to a list, which drops the
    media kind and the cutoff. ``start_from`` is inclusive, and applies under
    either order. ``keeper_id`` marks a suggested keeper.
    """

    media: str = "photos"
    order: str = "chronological"
    start_from: str | None = None
    album_id: object = None
    ids: tuple | None = None
    keeper_id: object = None

    def __post_init__(self):
        if self.media not in MEDIA or self.order not in ORDERS:
            raise ValueError(f"media must be of {tuple(MEDIA)}, order of {ORDERS}")


def scan(assets: DataFrame, spec: DeckSpec, album_assets: DataFrame | None = None) -> DataFrame:
    """The assets of the deck, before decisions and order."""
    if spec.ids is not None:
        return lookup(assets, spec.ids)
    conditions = []
    if MEDIA[spec.media]:
        conditions.append(F.col("media_type") == MEDIA[spec.media])
    if spec.start_from is not None:
        conditions.append(F.col("creation_date") >= F.lit(spec.start_from).cast(assets.schema["creation_date"].dataType))
    out = assets.where(reduce(lambda a, b: a & b, conditions)) if conditions else assets
    if spec.album_id is not None:
        out = out.join(album_assets.where(F.col("album_id") == spec.album_id).select("asset_id"), "asset_id", "left_semi")
    return out


def lookup(assets: DataFrame, ids: tuple) -> DataFrame:
    """The assets with the given ids; unknown ids are dropped, no ids give no rows."""
    if not ids:
        return assets.limit(0)
    if len(ids) <= 1_000:
        return assets.where(F.col("asset_id").isin(*ids))
    wanted = assets.sparkSession.createDataFrame([(i,) for i in ids], f"asset_id {assets.schema['asset_id'].dataType.simpleString()}")
    return assets.join(wanted, "asset_id", "left_semi")


def unreviewed(assets: DataFrame, review_state: DataFrame) -> DataFrame:
    return assets.join(review_state.where("reviewed").select("asset_id"), "asset_id", "left_anti")


def chronological(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("creation_date").asc_nulls_first(), "asset_id")


def largest_first(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """By size, unknown sizes as 0; ties by age."""
    sized = df.join(sizes.select("asset_id", "bytes"), "asset_id", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("bigint"))
    return sized.orderBy(F.col("bytes").desc(), F.col("creation_date").asc_nulls_first(), "asset_id")


def deck(
    assets: DataFrame, spec: DeckSpec, review_state: DataFrame, album_assets: DataFrame | None = None, sizes: DataFrame | None = None
) -> DataFrame:
    """The deck: scope, media and cutoff, without reviewed assets, in order."""
    rows = unreviewed(scan(assets, spec, album_assets), review_state)
    if spec.keeper_id is not None:
        rows = rows.withColumn("is_keeper", F.col("asset_id") == spec.keeper_id)
    return largest_first(rows, sizes) if spec.order == "largest_first" else chronological(rows)


def card(ordered: DataFrame, index: int) -> DataFrame:
    """The deck's row at a position; none once the deck is finished."""
    return ordered.offset(index).limit(1)
