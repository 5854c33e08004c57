"""Incremental twins: the index refresh and the decision fold, by micro-batches.

Every micro-batch is processed; none is dropped while another runs. A state is
a series of snapshots, one folder per batch, and a replayed batch rewrites its
own folder from the snapshot before it, so a restart gives the same result.
Only the last two snapshots are needed for that; older ones are deleted.

Streams take what is there and end (``ONCE``), or run on with any trigger of
``DataStreamWriter``, such as ``{"processingTime": "1 minute"}``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from assetloom.operators import index
from assetloom.storage import remove

ONCE = {"availableNow": True}


def snapshots(path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges each batch into the last snapshot."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = latest(spark, path, before=number)
        batch.persist()  # else each action on it reads the source again
        try:
            merge(last, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()
        numbers = stored(spark, path)
        remove(spark, *[f"{path}/batch={n}" for n in numbers if n < number and n not in numbers[-2:]])

    return apply


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest snapshot, or the newest before a batch; None if there is none."""
    numbers = [n for n in stored(spark, path) if before is None or n < before]
    return spark.read.parquet(f"{path}/batch={numbers[-1]}") if numbers else None


def stored(spark: SparkSession, path: str) -> list[int]:
    """Batches with a whole snapshot, in order."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    marked = [s.getPath() for s in fs.listStatus(root) if fs.exists(type_path(spark, s.getPath().toString() + "/_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in marked)


def type_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def stream_index(rows: DataFrame, library: Callable[[], DataFrame], path: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Refreshes the index snapshot with the rows that arrive, against the library of that time."""

    def merge(last: DataFrame | None, batch: DataFrame) -> DataFrame:
        new = batch.dropDuplicates(["asset_id"])
        return index.purge(new, library()) if last is None else index.refresh(last, new, library())

    return rows.writeStream.foreachBatch(snapshots(path, merge)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def fold_state(log: DataFrame) -> DataFrame:
    """The mergeable form of the fold: the last relevant decisions of each asset."""
    last = lambda c: F.max(F.when(c, F.struct("seq", "op")))
    return log.where(F.col("asset_id").isNotNull()).groupBy("asset_id").agg(last(F.col("op") != "spare").alias("r"), last(F.col("op") != "keep").alias("m"))


def merge_fold(last: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The state after a batch; a batch with a reset starts it anew."""
    reset = batch.where("op = 'reset'").agg(F.max("seq")).first()[0]
    live = batch if reset is None else batch.where(F.col("seq") > reset)
    now = fold_state(live.where("op <> 'reset'"))
    if last is None or reset is not None:
        return now
    return last.unionByName(now).groupBy("asset_id").agg(F.max("r").alias("r"), F.max("m").alias("m"))


def state_of(fold: DataFrame) -> DataFrame:
    return fold.select(
        "asset_id", F.coalesce(F.col("r.op").isin("keep", "mark"), F.lit(False)).alias("reviewed"), F.coalesce(F.col("m.op") == "mark", F.lit(False)).alias("marked")
    )


def stream_decisions(log: DataFrame, path: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Keeps the review state's fold up to date with a log that arrives in order."""
    return log.writeStream.foreachBatch(snapshots(path, merge_fold)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def processed(query: StreamingQuery) -> tuple[int, int]:
    """Batches with rows and rows that a query has processed, of those its progress still lists."""
    done = [p["numInputRows"] for p in query.recentProgress]
    return sum(1 for n in done if n), sum(done)


class Progress(StreamingQueryListener):
    """Calls back with the rows processed so far and the batch's number."""

    def __init__(self, callback: Callable[[int, int], None]):
        self.callback, self.rows = callback, 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        self.callback(self.rows, event.progress.batchId)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
