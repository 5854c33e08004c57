"""Review state, folded from an append-only log of decisions.

The last relevant decision of an asset decides each flag, so the fold is one
aggregation that keeps one value per asset and combines before the shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from assetloom.operators.ordered import RANGE_ROWS, with_previous
from assetloom.storage import Scratch

OPS = ("keep", "mark", "spare", "clear", "forget", "reset")


def last_op(condition: Column) -> Column:
    """The latest decision among those that meet the condition."""
    return F.max(F.when(condition, F.struct("seq", "op")))["op"]


def review_state(log: DataFrame) -> DataFrame:
    """``asset_id, reviewed, marked`` of every asset decided on since the last reset.

    Keep and mark review an asset, mark marks it, spare takes the mark and
    leaves it reviewed, clear and forget take both. Null ids belong to resets
    alone.
    """
    reset = log.where("op = 'reset'").agg(F.max("seq")).scalar()
    live = log.where(F.col("seq") > F.coalesce(reset, F.lit(-(1 << 63))))
    live = live.where(F.col("asset_id").isNotNull() & (F.col("op") != "reset"))
    folded = live.groupBy("asset_id").agg(last_op(F.col("op") != "spare").alias("r"), last_op(F.col("op") != "keep").alias("m"))
    return folded.select(
        "asset_id", F.coalesce(F.col("r").isin("keep", "mark"), F.lit(False)).alias("reviewed"),
        F.coalesce(F.col("m") == "mark", F.lit(False)).alias("marked"),
    )


def review_counts(state: DataFrame) -> DataFrame:
    return state.agg(F.count_if("reviewed").alias("reviewed"), F.count_if("marked").alias("marked"))


def toggled(state: DataFrame, ids: DataFrame) -> DataFrame:
    """The op that a toggle logs for each id: spare if marked, else mark."""
    marked = state.select("asset_id", "marked")
    return ids.select("asset_id").join(marked, "asset_id", "left").select(
        "asset_id", F.when(F.coalesce("marked", F.lit(False)), "spare").otherwise("mark").alias("op")
    )


def undo_validity(log: DataFrame, deck: str, arms: tuple[str, ...] = ("keep", "mark"), ignored: tuple[str, ...] = ("spare",), range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every undo (``clear``) of a deck, and whether a swipe had armed it.

    One step: an undo works right after a swipe. Another undo, a reload or a
    confirmed delete disarm it; edits in the review sheet do not matter. The
    log is cut into ranges, so that a deck's whole log need not fit a task.
    """
    relevant = log.where(~F.col("op").isin(*ignored))
    out = with_previous(relevant, Scratch(log.sparkSession, "undo"), [deck, "seq"], [deck, "op"], "before", range_rows)
    valid = F.col(f"before.{deck}").eqNullSafe(F.col(deck)) & F.col("before.op").isin(*arms)
    return out.where("op = 'clear'").select("seq", deck, F.coalesce(valid, F.lit(False)).alias("valid"))


class Deletion(NamedTuple):
    """The assets that stay, the log's row, and the decisions that clear the marks of what is gone."""

    survivors: DataFrame
    record: DataFrame
    forgotten: DataFrame


def confirm_delete(assets: DataFrame, resources: DataFrame, marked: DataFrame) -> Deletion:
    """A confirmed delete.

    The log's row has the number of marks, also of assets that were gone, and
    the bytes of those there; all marks are forgotten then. If no mark
    resolves, the delete fails: all assets stay, and there is neither a row
    nor a decision.
    """
    ids = marked.select("asset_id").distinct()
    live = ids.join(assets.select("asset_id"), "asset_id", "left_semi")
    freed = resources.join(live, "asset_id", "left_semi").agg(F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint")).scalar()
    found = live.agg(F.count(F.lit(1))).scalar()
    record = ids.agg(F.count(F.lit(1)).alias("count")).where(found > 0).select("count", freed.alias("bytes_freed"))
    forgotten = ids.where(found > 0).select("asset_id", F.lit("forget").alias("op"))
    return Deletion(assets.join(ids, "asset_id", "left_anti"), record, forgotten)
