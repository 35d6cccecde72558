"""Streaming append to a stored time-grid pyramid that range queries and views read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.model import AggregateSpec, spec_of
from tidegrid.operators.pyramid import FANOUT, GridShape, Pyramid, build_time_pyramid, with_grid_parent
from tidegrid.sources.store import read_shape, write_points, write_shape
from tidegrid.streaming.ingest import Batch


def append_batches(path: str, kind: str | AggregateSpec = "num", base_ms: int = 60_000, fanout: int = FANOUT,
                   levels: int = 5) -> Batch:
    """A ``foreachBatch`` function that stores the points and nodes of each batch under its id.

    Nothing stored before is rewritten, and a repeated batch replaces its own folders. The grid is stored with
    them; appending by another one fails.
    """
    spec, shape = spec_of(kind), GridShape(base_ms, fanout, levels)
    spec.needs_no_next("a batch")

    def run(batch: DataFrame, batch_id: int) -> None:
        write_shape(batch.sparkSession, path, spec, shape)
        new = build_time_pyramid(batch.select("series", "t", "v"), spec, base_ms, fanout, levels)
        write_points(new.points, f"{path}/points/batch={batch_id}")
        (new.nodes.drop("parent_id", "parent_span").write.mode("overwrite")
         .partitionBy("level").parquet(f"{path}/nodes/batch={batch_id}"))
    return run


def _merged(nodes: DataFrame, spec: AggregateSpec) -> DataFrame:
    return nodes.groupBy("series", "level", "node_id").agg(
        F.min("min_t").alias("min_t"), F.max("max_t").alias("max_t"), *spec.merged())


def _batches(spark: SparkSession, path: str, part: str, after: int, upto: int | None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/{part}").filter(F.col("batch") > after)
    return (rows if upto is None else rows.filter(F.col("batch") <= upto)).drop("batch")


def read_appended(spark: SparkSession, path: str, base: str | None = None, after: int = -1) -> Pyramid:
    """The pyramid of all batches merged; with a compacted ``base``, only batches later than ``after`` are added."""
    kind, shape = read_shape(spark, path)
    points, nodes = (_batches(spark, path, part, after, None) for part in ("points", "nodes"))
    if base is not None:
        if read_shape(spark, base) != (kind, shape):
            raise ValueError(f"{base} was not compacted from {path}")
        points = points.unionByName(spark.read.parquet(f"{base}/points"))
        nodes = nodes.unionByName(spark.read.parquet(f"{base}/nodes"))
    merged = _merged(nodes.withColumn("level", F.col("level").cast("int")), spec_of(kind))
    return Pyramid(points, with_grid_parent(merged, shape.fanout, shape.levels), spec_of(kind), shape)


def compact(spark: SparkSession, path: str, into: str, upto: int | None = None) -> None:
    """Merge the batches up to an id into a folder for ``read_appended``'s ``base``."""
    kind, shape = read_shape(spark, path)
    write_shape(spark, into, spec_of(kind), shape)
    write_points(_batches(spark, path, "points", -1, upto), f"{into}/points")
    _merged(_batches(spark, path, "nodes", -1, upto), spec_of(kind)).write.partitionBy("level").parquet(f"{into}/nodes")
