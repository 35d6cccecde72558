"""Stored points and pyramids."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.model import AggregateSpec, spec_of
from tidegrid.operators.pyramid import (FANOUT, LEAF_SIZE, CountShape, GridShape, Pyramid, nodes_of_placed,
                                         place_points)


def write_points(points: DataFrame, path: str, files: int | None = None) -> None:
    """Write points sorted by series and time, so that a range query skips files and row groups.

    The range partitioning also spreads a large series over many files.
    """
    by = ["series", "t"]
    spread = points.repartitionByRange(files, *by) if files else points.repartitionByRange(*by)
    spread.sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _write_nodes(nodes: DataFrame, path: str) -> None:
    """Nodes split by level and sorted by series and time."""
    by = ["level", "series", "min_t"]
    (nodes.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite")
     .partitionBy("level").parquet(f"{path}/nodes"))


SHAPE = "kind string, leaf_size long, fanout long, base_ms long, levels long"


def write_shape(spark: SparkSession, path: str, spec: AggregateSpec, shape: CountShape | GridShape) -> None:
    """One row that says how the pyramid in ``path`` is cut; another shape there already is an error."""
    try:
        there = read_shape(spark, path)
    except AnalysisException:
        there = None
    if there is not None and there != (spec.kind, shape):
        raise ValueError(f"{path} holds a pyramid of {there}, not of {(spec.kind, shape)}")
    if there is None:
        row = (spec.kind, getattr(shape, "leaf_size", None), shape.fanout, getattr(shape, "base_ms", None),
               getattr(shape, "levels", None))
        spark.createDataFrame([row], SHAPE).coalesce(1).write.parquet(f"{path}/shape")


def read_shape(spark: SparkSession, path: str) -> tuple[str, CountShape | GridShape]:
    """The kind and the shape of the pyramid in ``path``."""
    r = spark.read.schema(SHAPE).parquet(f"{path}/shape").first()
    if r["leaf_size"] is not None:
        return r["kind"], CountShape(r["leaf_size"], r["fanout"])
    return r["kind"], GridShape(r["base_ms"], r["fanout"], r["levels"])


def _spec_there(kind: str | AggregateSpec | None, there: str, path: str) -> AggregateSpec:
    spec = spec_of(there if kind is None else kind)
    if spec.kind != there:
        raise ValueError(f"{path} holds a pyramid of kind {there}, not {spec.kind}")
    return spec


def write_pyramid(pyramid: Pyramid, path: str) -> None:
    """Write points, nodes and shape of any pyramid."""
    write_shape(pyramid.points.sparkSession, path, pyramid.spec, pyramid.shape)
    write_points(pyramid.points, f"{path}/points")
    _write_nodes(pyramid.nodes, path)


def read_pyramid(spark: SparkSession, path: str, kind: str | AggregateSpec | None = None) -> Pyramid:
    """The pyramid in ``path`` with the shape it was stored with; ``kind`` must be the stored one, and is it if left out."""
    there, shape = read_shape(spark, path)
    nodes = spark.read.parquet(f"{path}/nodes").withColumn("level", F.col("level").cast("int"))
    return Pyramid(spark.read.parquet(f"{path}/points"), nodes, _spec_there(kind, there, path), shape)


def store_pyramid(points: DataFrame, path: str, kind: str | AggregateSpec = "num", leaf_size: int = LEAF_SIZE,
                  fanout: int = FANOUT) -> Pyramid:
    """Build the count-based pyramid of points into ``path`` and read it back.

    The points are placed and written first and the nodes come from what was written, so that the positions
    are computed once.
    """
    spark, spec, shape = points.sparkSession, spec_of(kind), CountShape(leaf_size, fanout)
    write_shape(spark, path, spec, shape)
    write_points(place_points(spec.prepared(points), shape).drop("series_n"), f"{path}/points")
    _write_nodes(nodes_of_placed(read_points(spark, f"{path}/points"), spec, shape), path)
    return read_pyramid(spark, path, spec)
