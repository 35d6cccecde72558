"""Python functions on Arrow batches, with this package at hand wherever they run."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tidegrid


def send_package(spark: SparkSession) -> None:
    """Let Spark hand this package to every worker, once per application; executors need no copy of their own."""
    context = spark.sparkContext
    if getattr(context, "_tidegrid_sent", False):
        return
    top = os.path.dirname(os.path.abspath(tidegrid.__file__))
    if os.path.isdir(top):  # else it came in an archive itself
        path = os.path.join(tempfile.mkdtemp(prefix="tidegrid-"), "tidegrid.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in sorted(os.walk(top)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        file = os.path.join(folder, name)
                        z.write(file, os.path.join("tidegrid", os.path.relpath(file, top)))
        context.addPyFile(path)  # the driver serves it to the executors
    context._tidegrid_sent = True


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` alone: other columns are not read, and their names cannot clash with new ones."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def release() -> None:
    """Give memory that is free back to the system: a worker serves one stage after the other and would keep the most of any."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there with glibc
    if trim:
        trim(0)


def released(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``fn``, and ``release`` at the end of a task."""
    @functools.wraps(fn)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release()
    return run


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str | T.StructType) -> DataFrame:
    send_package(df.sparkSession)
    return df.mapInArrow(released(fn), schema)


def map_groups(df: DataFrame, key: str | list[str], fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` on all rows of each value of ``key``, a column or several."""
    send_package(df.sparkSession)
    return df.groupBy(key).applyInArrow(fn, schema)
