"""Streaming ingest of wide CSV files and the order guard over micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.points import mark_backward
from tidegrid.operators.scan import SLAB_BITS
from tidegrid.sources.wide_csv import (Layout, cell_schema, csv_options, in_one_order, melt_kind, row_in_task, zip_arrays)

Batch = Callable[[DataFrame, int], None]


def stream_cells(spark: SparkSession, folder: str, layout: Layout, multi_line: bool = False,
                 files_per_batch: int | None = None) -> DataFrame:
    """Rows of files arriving in a folder: cells ``c0..`` as text, ``file`` and the first byte of the row's split.

    The layout is fixed beforehand, from a file that is already there. A file with another header fails the query.
    """
    names = layout.header
    if len(set(map(str.lower, names))) != len(names):
        raise ValueError("a stream's columns need distinct names")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    reader = spark.readStream.schema(schema).options(**csv_options(multi_line, len(names)) | {"enforceSchema": "false"})
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    cells = reader.csv(folder).select("*", "_metadata.file_path", "_metadata.file_block_start")
    return cells.toDF(*cell_schema(len(names)).names, "file", "split")


def stream_wide_csv(spark: SparkSession, folder: str, layout: Layout, kind: str = "num", strict: bool = True,
                    multi_line: bool = False) -> DataFrame | None:
    """Points of the single columns of a kind, with their ``file``, from files arriving in a folder."""
    return melt_kind(stream_cells(spark, folder, layout, multi_line), layout, kind, strict, carried=["file"])


def melt_batches(layout: Layout, sinks: Mapping[str, Batch], strict: bool = True) -> Batch:
    """A ``foreachBatch`` function over ``stream_cells`` that hands the points of every kind with a sink to it.

    Arrays are made of the rows of one file, which are all in one batch. The files of a batch follow each other by
    name: ``pos`` increases over them, as ``guard_batches`` asks for.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        # a batch's tasks are its splits, so the order of rows in a task is that in the file
        batch = batch.withColumn("pos", F.col("split") + row_in_task()).drop("split").persist()
        rows = in_one_order(batch)
        try:
            for kind, sink in sinks.items():
                points = zip_arrays(rows, layout, strict) if kind == "arr" else melt_kind(rows, layout, kind, strict)
                if points is not None:
                    sink(points.drop("file"), batch_id)
        finally:
            batch.unpersist()
    return run


def guard_batches(state_path: str, sink: Batch, pos: str, bits: int = SLAB_BITS) -> Batch:
    """A ``foreachBatch`` function that passes the points moving their series forward on to ``sink``.

    Inside a batch the guard is the batch operator, so a large series is split over tasks. The last time
    of every series is a small table in ``state_path`` with two slots, written in turn, each with the id of the
    batch that wrote it: a batch reads what its predecessor wrote, so a repeated batch sees the same state and
    gives the same result. Missing state fails; only the first batch of a new folder has none.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            last = _state_before(spark, state_path, batch_id)
            marked = mark_backward(batch, pos, last_times=last, bits=bits)
            sink(marked.filter("kept").drop("kept"), batch_id)
            seen = batch.groupBy("series").agg(F.max("t").alias("last_t")).unionByName(last)
            seen = seen.groupBy("series").agg(F.max("last_t").alias("last_t"))
            marker = spark.createDataFrame([(None, None)], _STATE)  # a row even if there are no series yet
            (seen.unionByName(marker).withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
             .parquet(f"{state_path}/slot={batch_id % 2}"))
        finally:
            batch.unpersist()
    return run


_STATE = "series STRING, last_t BIGINT"


def _state_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The last times that the batch before has written."""
    slot = f"{path}/slot={(batch_id + 1) % 2}"
    try:
        stored = spark.read.schema(f"{_STATE}, batch BIGINT").parquet(slot)
    except AnalysisException:
        if batch_id:
            raise ValueError(f"the state of batch {batch_id - 1} is not in {slot}") from None
        return spark.createDataFrame([], _STATE)
    wrote = stored.agg(F.max("batch")).first()[0]
    if batch_id == 0:  # the other slot is written by batch 1, after this one
        raise ValueError(f"{path} holds the state of batch {wrote}; a new query needs a new folder")
    if wrote != batch_id - 1:
        raise ValueError(f"the state in {slot} is of batch {wrote}, not of batch {batch_id - 1}")
    return stored.filter("series IS NOT NULL").drop("batch")


def parquet_sink(path: str) -> Batch:
    """Writes each batch to a folder of its own; a repeated batch replaces what it wrote."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write
