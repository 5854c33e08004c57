"""Intermediate tables in the folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local sessions without a shared one, by application.
_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a session in local mode may fall back to a temporary folder, because
    on a cluster no other machine would see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if context.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="assetloom-")
    return _LOCAL_ROOTS[context.applicationId]


#: Scratches made since each open ``cleared`` began.
_WATCHED: list[list[Scratch]] = []


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, all tables of the scratches made inside; results must be stored elsewhere by then."""
    made: list[Scratch] = []
    _WATCHED.append(made)
    try:
        yield
    finally:
        _WATCHED[:] = [x for x in _WATCHED if x is not made]
        remove(spark, *[scratch.base for scratch in made])


class Scratch:
    """Writes intermediate results as Parquet and rereads them, which cuts lineage.

    Files survive the loss of any executor. ``drop`` removes tables that no
    later plan reads; tables behind a returned DataFrame stay.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[str] = []
        for made in _WATCHED:
            made.append(self)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.tables.append(path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Removes stored tables, of this or another scratch."""
        remove(self.spark, *[frame._scratch_path for frame in frames])

    def clear(self, *keep: DataFrame) -> None:
        """Removes all tables of this scratch but those given."""
        kept = {frame._scratch_path for frame in keep}
        remove(self.spark, *[path for path in self.tables if path not in kept])
        self.tables = [path for path in self.tables if path in kept]


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders, wherever they are stored; what is gone already is no error."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hadoop).delete(path, True)
