"""Count-based pyramids that grow in place: an append writes what it changes, and a reader masks what that replaces.

Besides its points and nodes a part holds its cuts: for every series and level the first node that it has, and the first
position. From there on it stands for all older parts, so a row is masked when its place is not before the next part's cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.model import AggregateSpec, spec_of
from tidegrid.operators.pyramid import FANOUT, LEAF_SIZE, CountShape, Pyramid, append_delta, nodes_of_placed, place_points
from tidegrid.sources.manifest import Manifest, Part, commit, read_manifest, read_parts, to_merge
from tidegrid.sources.store import write_points

#: The level under which the cuts of points are listed.
POINTS = -1


def _spec(manifest: Manifest, kind: str | AggregateSpec | None) -> AggregateSpec:
    spec = spec_of(manifest.kind if kind is None else kind)
    if spec.kind != manifest.kind:
        raise ValueError(f"a pyramid of kind {manifest.kind}, not {spec.kind}, is there")
    return spec


def _there(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    manifest = read_manifest(spark, path, version)
    if manifest is None:
        raise ValueError(f"no stored pyramid in {path}")
    return manifest


def _write_nodes(nodes: DataFrame, path: str) -> None:
    by = ["level", "series", "min_t"]
    nodes.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy("level").parquet(path)


def _write_cuts(spark: SparkSession, path: str, name: str) -> None:
    """The cuts of a part, from what was written of it."""
    points = spark.read.parquet(f"{path}/points/part={name}")
    nodes = spark.read.parquet(f"{path}/nodes/part={name}")
    cuts = (points.groupBy("series").agg(F.min("pos").alias("first")).withColumn("level", F.lit(POINTS))
            .unionByName(nodes.groupBy("series", F.col("level").cast("int").alias("level")).agg(F.min("node_id").alias("first"))))
    cuts.coalesce(1).write.parquet(f"{path}/cuts/part={name}")  # a row for each series and level


def _live(rows: DataFrame, cuts: DataFrame, level, place: str) -> DataFrame:
    """The rows of several parts that no younger part replaces. ``cuts`` of a level never go back from part to part."""
    younger = Window.partitionBy("series", "level").orderBy("part")
    until = cuts.select("series", F.col("level").alias("_level"), "part", F.lead("first").over(younger).alias("_until"))
    marked = rows.withColumn("_level", level).join(until, ["series", "_level", "part"], "left")
    return marked.filter(F.col("_until").isNull() | (F.col(place) < F.col("_until"))).drop("_level", "_until", "part")


def _rows(spark: SparkSession, path: str, parts: Sequence[Part]) -> tuple[DataFrame, DataFrame]:
    """Points and nodes of the parts, without those that are replaced among them."""
    points, nodes, cuts = (read_parts(spark, path, what, parts) for what in ("points", "nodes", "cuts"))
    nodes = nodes.withColumn("level", F.col("level").cast("int"))
    if len(parts) == 1:
        return points.drop("part"), nodes.drop("part")
    return _live(points, cuts, F.lit(POINTS), "pos"), _live(nodes, cuts, F.col("level"), "node_id")


def create_stored(points: DataFrame, path: str, kind: str | AggregateSpec = "num", leaf_size: int = LEAF_SIZE,
                  fanout: int = FANOUT) -> Pyramid:
    """The pyramid of ``points`` as version 1 in ``path``."""
    spark, spec, shape = points.sparkSession, spec_of(kind), CountShape(leaf_size, fanout)
    first = Manifest(0, spec.kind, shape)
    name = first.new_name()
    write_points(place_points(spec.prepared(points), shape).drop("series_n"), f"{path}/points/part={name}")
    placed = spark.read.parquet(f"{path}/points/part={name}")
    _write_nodes(nodes_of_placed(placed, spec, shape), f"{path}/nodes/part={name}")
    _write_cuts(spark, path, name)
    commit(spark, path, first.with_part(name, placed.count()))
    return read_stored(spark, path, spec)


def read_stored(spark: SparkSession, path: str, kind: str | AggregateSpec | None = None, version: int | None = None) -> Pyramid:
    """The pyramid of a version, or of the latest; it stays that version while others are written."""
    manifest = _there(spark, path, version)
    return Pyramid(*_rows(spark, path, manifest.parts), _spec(manifest, kind), manifest.shape)


def append_stored(points: DataFrame, path: str, pos: str, kind: str | AggregateSpec | None = None) -> Pyramid:
    """Add later points, in ``pos`` order, as a part of their own; equals building the pyramid from all points at once.

    Written are the new points, those of the last leaf of each series that grows, and the nodes above them. Points that are not
    later than what their series holds are dropped. A failure before the end leaves the version that was there; a writer that
    was faster makes this one fail with ``Conflict``.
    """
    spark = points.sparkSession
    manifest = _there(spark, path)
    spec = _spec(manifest, kind)
    delta = append_delta(Pyramid(*_rows(spark, path, manifest.parts), spec, manifest.shape), points, pos)
    if not delta.points.take(1):
        return read_stored(spark, path, spec, manifest.version)
    name = manifest.new_name()
    write_points(delta.points, f"{path}/points/part={name}")
    _write_nodes(delta.nodes, f"{path}/nodes/part={name}")
    _write_cuts(spark, path, name)
    commit(spark, path, manifest.with_part(name, spark.read.parquet(f"{path}/points/part={name}").count()))
    return read_stored(spark, path, spec)


def compact_stored(spark: SparkSession, path: str) -> int:
    """Merge the youngest parts where they are not much smaller than the one before them; gives the number of parts left.

    Called after each append it rewrites a row a logarithmic number of times, and reads open as many parts. Readers of older
    versions go on reading those.
    """
    manifest = _there(spark, path)
    begin = to_merge(manifest.parts)
    if begin is None:
        return len(manifest.parts)
    merged = manifest.parts[begin:]
    points, nodes = _rows(spark, path, merged)
    name = f"{merged[-1].name.split('-')[0]}-{manifest.new_name().split('-')[1]}"  # as old as its youngest
    write_points(points, f"{path}/points/part={name}")
    _write_nodes(nodes, f"{path}/nodes/part={name}")
    cuts = read_parts(spark, path, "cuts", merged).groupBy("series", "level").agg(F.min("first").alias("first"))
    cuts.coalesce(1).write.parquet(f"{path}/cuts/part={name}")
    rows = spark.read.parquet(f"{path}/points/part={name}").count()
    commit(spark, path, manifest.with_merged(begin, name, rows))
    return begin + 1
