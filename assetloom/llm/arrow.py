"""Arrow batches in and out of Python, by the partition."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows of one call at most, so that what a call builds stays small.
CHUNK_ROWS = 512
#: Bytes of one Arrow batch between the JVM and Python at most. The default of
#: 64 MB makes buffers of several times that in each task.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's size of Arrow batches to ``BATCH_BYTES``; never raises it.

    Spark reads this setting when a plan is made, so it stays set.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Returns a worker's free memory to the system when a task ends.

    Workers outlive their tasks, and what they keep adds to the executor's
    memory in every later stage.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """The driver's rows as a DataFrame that only the JVM handles.

    From a list of rows Spark would make an RDD of pickles, which a second
    Python daemon on every executor converts; its workers stay.
    """
    kind = _parse_datatype_string(schema)
    columns = list(zip(*rows)) or [()] * len(kind)
    arrow = to_arrow_schema(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), kind)


def utf8(column) -> list[bytes]:
    """A string column as UTF-8 bytes; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(pc.cast(column, pa.binary()), b"").to_pylist()


def map_chunks(df: DataFrame, make: Callable[[], Callable], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` whose function gets a ``RecordBatch`` of few rows and gives a dict of columns.

    ``make`` runs once for each task and returns that function.
    """
    bound_batches(df.sparkSession)
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                out = step(batch.slice(at, CHUNK_ROWS))
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f, x in ((f, out[f.name]) for f in arrow)],
                    schema=arrow,
                )
        del step
        give_back()

    return df.mapInArrow(run, kind)
