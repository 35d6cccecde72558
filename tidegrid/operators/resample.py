"""Resampling onto an aligned grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.model import AggregateSpec, floor_to, lift_points, spec_of

PX_PER_POINT = 3.0  # a point per this many pixels of width


def min_resolution(start: Column, end: Column, width_px: Column | int) -> Column:
    """The resolution in ms that gives one point per three pixels."""
    width = width_px if isinstance(width_px, Column) else F.lit(width_px)
    return ((end - start).cast("double") / width * PX_PER_POINT).cast("long")


def resample(rows: DataFrame, resolution: Column | int, kind: str | AggregateSpec = "num",
             keys: Sequence[str] = ("series",)) -> DataFrame:
    """Merge rows of a range query that lie in the same bucket of ``resolution`` ms.

    Buckets start at whole multiples of the resolution. A row that crosses one stays alone, and a
    group of one row passes unchanged (a point stays a point). A resolution that is not positive
    merges nothing; it may be a column, so that each series has its own.
    """
    spec = spec_of(kind)
    if isinstance(resolution, int):
        if resolution <= 0:
            return rows
        low, high = floor_to(F.col("min_t"), resolution), floor_to(F.col("max_t"), resolution)
    else:
        def bucket(t: str) -> Column:
            return F.when(resolution > 0, floor_to(F.col(t), resolution)).otherwise(F.col(t))
        low, high = bucket("min_t"), bucket("max_t")

    return _merged_groups(rows, spec, keys, low.alias("_low"), high.alias("_high"))


def _merged_groups(rows: DataFrame, spec: AggregateSpec, keys: Sequence[str], *buckets: Column) -> DataFrame:
    alone = F.count(F.lit(1)) == 1
    value = [F.when(alone, F.first("v")).alias("v")] if spec.keep_value else []
    return rows.groupBy(*keys, *buckets).agg(
        (alone & F.bool_and("is_leaf")).alias("is_leaf"),
        F.min("min_t").alias("min_t"), F.max("max_t").alias("max_t"), *spec.merged(), *value).drop("_low", "_high")


def tumble(points: DataFrame, resolution: int, kind: str | AggregateSpec = "num") -> DataFrame:
    """Aggregate points per bucket of ``resolution`` ms; ``t`` is the bucket's start."""
    spec = spec_of(kind)
    rows = spec.prepared(points).withColumn("_bucket", floor_to(F.col("t"), resolution))
    return spec.of_points(rows, "series", "_bucket", spans=False).withColumnRenamed("_bucket", "t")


def resample_points(points: DataFrame, resolution: int, kind: str | AggregateSpec = "num") -> DataFrame:
    """``resample`` of raw points, which never cross a bucket's end."""
    spec = spec_of(kind)
    if resolution > 0 and spec.from_points is not None:
        rows = spec.prepared(points).withColumn("_low", floor_to(F.col("t"), resolution))
        if spec.keep_value:
            raise ValueError("a kind of two functions cannot keep single values here")
        found = spec.of_points(rows, "series", "_low", count="_n")
        return found.select("series", (F.col("_n") == 1).alias("is_leaf"), "min_t", "max_t", *spec.state)
    rows = lift_points(points, spec)
    if resolution <= 0:
        return rows
    return _merged_groups(rows, spec, ["series"], floor_to(F.col("min_t"), resolution).alias("_low"))
