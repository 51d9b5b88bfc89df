"""What the operators share: the shared folder, written intermediate tables, small checks."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources.shared import Scratch, drop_written, new_path, shared_dir, written

__all__ = ["Scratch", "ascii_lower", "drop_written", "hand_back", "lean", "new_path", "row_key", "shared_dir", "small_batches", "small_table", "table", "written"]

def row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__file, __row``: file and place of each row, two numbers that no other row has.

    ``docs`` must be read from Parquet (or be what filters leave of such a table), so that the key is the same each time
    it is read; other frames are written first.
    """
    try:
        docs.select("_metadata.row_index").schema  # noqa: B018
    except Exception:  # noqa: BLE001  no file behind it
        docs = written(docs, "rows")
    return docs.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also change other letters)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of a ``mapInArrow``, which hands memory that its task has freed back to the system: workers outlive tasks and stages."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        hand_back()

    return task


def hand_back() -> None:
    """Freed memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def small_table(spark: SparkSession, rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> DataFrame:
    """A few rows of the driver's as a table, by Arrow: plain lists go through an RDD of pickles, for which each executor starts and keeps further Python workers."""
    columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(schema)]
    return spark.createDataFrame(pa.table(columns, schema=pa.schema(schema)))


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Jobs within the block hand Python at most ``rows`` rows at a time: whole texts by the 10,000 fill buffers of JVM and worker, off the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
