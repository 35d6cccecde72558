"""Aggregates of points and nodes, and what a catalog shows of a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.model import AggregateSpec, spec_of
from tidegrid.operators.pyramid import Pyramid


def agg_points(points: DataFrame, kind: str | AggregateSpec, keys: Sequence[str] = ("series",)) -> DataFrame:
    """State of all points per key."""
    return spec_of(kind).of_points(points, *keys, spans=False)


def agg_nodes(nodes: DataFrame, kind: str | AggregateSpec, keys: Sequence[str] = ("series",)) -> DataFrame:
    """State of all nodes per key, with the time span they cover."""
    return nodes.groupBy(*keys).agg(
        F.min("min_t").alias("min_t"), F.max("max_t").alias("max_t"), *spec_of(kind).merged())


def with_mean(states: DataFrame) -> DataFrame:
    return states.withColumn("mean", F.col("total") / F.col("n"))


def top_nodes(pyramid: Pyramid) -> DataFrame:
    """One row per series and top node: what a whole series adds up to, without its points."""
    return pyramid.nodes.filter("parent_id is null")


def series_summary(points: DataFrame | Pyramid, kind: str | AggregateSpec = "num") -> DataFrame:
    """Aggregate and time span of every whole series; of a pyramid, whose kind counts, from its top nodes."""
    if isinstance(points, Pyramid):
        return points.spec.with_finals(agg_nodes(top_nodes(points), points.spec))
    spec = spec_of(kind)
    return spec.with_finals(spec.of_points(points, "series"))


def value_limits(points: DataFrame | Pyramid, series: Sequence[str] | None = None, kind: str = "num") -> DataFrame:
    """Smallest and largest value over the chosen series: one row; of a pyramid from its top nodes."""
    rows = top_nodes(points) if isinstance(points, Pyramid) else points
    chosen = rows if series is None else rows.filter(F.col("series").isin(*series))
    lifted = chosen if isinstance(points, Pyramid) else chosen.select(*spec_of(kind).lifted(F.col("v")))
    return lifted.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def time_extent(points: DataFrame | Pyramid) -> DataFrame:
    """First and last time of every series; of a pyramid from its top nodes."""
    if isinstance(points, Pyramid):
        return top_nodes(points).groupBy("series").agg(F.min("min_t").alias("min_t"), F.max("max_t").alias("max_t"))
    return points.groupBy("series").agg(F.min("t").alias("min_t"), F.max("t").alias("max_t"))


def distinct_values(points: DataFrame) -> DataFrame:
    return points.select("series", "v").distinct()


def catalog(marked: DataFrame, kind: str) -> DataFrame:
    """One row per series from points marked by ``mark_backward``: submitted and kept counts, span, kind."""
    kept_t = F.when(F.col("kept"), F.col("t"))
    return marked.groupBy("series").agg(
        F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_submitted"),
        F.count(kept_t).alias("n_points"), F.min(kept_t).alias("min_t"), F.max(kept_t).alias("max_t"))
