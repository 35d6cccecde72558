"""Streaming append in runs: what a batch brings is a part of the next version, and parts are merged by size as they come.

A read opens a logarithmic number of parts, however many batches have been, and sees one version: neither half a batch nor half
a merge. Each row is rewritten a logarithmic number of times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.model import AggregateSpec, spec_of
from tidegrid.operators.pyramid import FANOUT, GridShape, Pyramid, build_time_pyramid, with_grid_parent
from tidegrid.sources.manifest import Manifest, commit, read_manifest, read_parts, to_merge
from tidegrid.sources.store import write_points
from tidegrid.streaming.ingest import Batch


def append_runs(path: str, kind: str | AggregateSpec = "num", base_ms: int = 60_000, fanout: int = FANOUT, levels: int = 5,
                merge: bool = True) -> Batch:
    """A ``foreachBatch`` function that adds the points and nodes of each batch on a time grid, exactly once.

    The version that holds a batch also says so, for each streaming query by its id: a batch that comes again is not added
    again, and a stream that begins anew is not taken for an old one. With ``merge`` parts are merged after the batch; else
    ``merge_runs`` may be called elsewhere. Another kind or grid than the stored one is an error.
    """
    spec, shape = spec_of(kind), GridShape(base_ms, fanout, levels)
    spec.needs_no_next("a batch")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        manifest = read_manifest(spark, path) or Manifest(0, spec.kind, shape)
        if (manifest.kind, manifest.shape) != (spec.kind, shape):
            raise ValueError(f"{path} holds a pyramid of {(manifest.kind, manifest.shape)}, not of {(spec.kind, shape)}")
        if batch_id <= manifest.batches.get(stream, -1):
            return
        done, name = manifest.batches | {stream: batch_id}, manifest.new_name()
        new = build_time_pyramid(batch.select("series", "t", "v"), spec, base_ms, fanout, levels)
        write_points(new.points, f"{path}/points/part={name}")
        points = spark.read.schema(new.points.schema).parquet(f"{path}/points/part={name}")
        rows = points.count()
        if rows == 0:
            commit(spark, path, manifest.after(batches=done))
            return
        # nodes from what was written: the stream's source is read once
        nodes = build_time_pyramid(points.select("series", "t", "v"), spec, base_ms, fanout, levels).nodes
        _write_nodes(nodes.drop("parent_id", "parent_span"), f"{path}/nodes/part={name}")
        commit(spark, path, manifest.with_part(name, rows, batches=done))
        if merge:
            merge_runs(spark, path)
    return run


def _write_nodes(nodes: DataFrame, path: str) -> None:
    nodes.repartitionByRange("level", "series", "node_id").sortWithinPartitions("level", "series", "node_id").write.partitionBy(
        "level").parquet(path)


def _merged(nodes: DataFrame, spec: AggregateSpec) -> DataFrame:
    return nodes.groupBy("series", F.col("level").cast("int").alias("level"), "node_id").agg(
        F.min("min_t").alias("min_t"), F.max("max_t").alias("max_t"), *spec.merged())


def merge_runs(spark: SparkSession, path: str) -> int:
    """Merge the youngest parts where they are not much smaller than the one before; gives the number of parts left."""
    manifest = read_manifest(spark, path)
    if manifest is None:
        return 0
    begin = to_merge(manifest.parts)
    if begin is None:
        return len(manifest.parts)
    merged = manifest.parts[begin:]
    name = f"{merged[-1].name.split('-')[0]}-{manifest.new_name().split('-')[1]}"
    write_points(read_parts(spark, path, "points", merged).drop("part"), f"{path}/points/part={name}")
    _write_nodes(_merged(read_parts(spark, path, "nodes", merged), spec_of(manifest.kind)), f"{path}/nodes/part={name}")
    commit(spark, path, manifest.with_merged(begin, name, sum(p.rows for p in merged)))
    return begin + 1


def read_runs(spark: SparkSession, path: str, version: int | None = None) -> Pyramid:
    """The pyramid of a version, or of the latest: nodes of the same place are merged, of as many parts as there are."""
    manifest = read_manifest(spark, path, version)
    if manifest is None or not manifest.parts:
        raise ValueError(f"no batch has arrived in {path}")
    spec, shape = spec_of(manifest.kind), manifest.shape
    points, nodes = (read_parts(spark, path, what, manifest.parts) for what in ("points", "nodes"))
    return Pyramid(points.drop("part"), with_grid_parent(_merged(nodes, spec), shape.fanout, shape.levels), spec, shape)
