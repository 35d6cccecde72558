"""Range query at a minimum resolution (level of detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.model import lift_points
from tidegrid.operators.pyramid import Pyramid


# A checked count of at most this many (series, node_id) rows, some 10 MB, is broadcast
FEW_LEAVES = 100_000
EARLIEST, LATEST = -(1 << 62), 1 << 62


def in_range(start: Column | int, end: Column | int) -> Column:
    """Whether a node touches the range: the start is included, the end is not."""
    return (F.col("max_t") >= start) & (F.col("min_t") < end)


def coarse_nodes(nodes: DataFrame, start: Column | int, end: Column | int, resolution: Column | int) -> DataFrame:
    """The highest nodes in range that span at most ``resolution`` ms. One filter, no join."""
    span = F.col("max_t") - F.col("min_t")
    fits = (span <= resolution) & (F.col("parent_span").isNull() | (F.col("parent_span") > resolution))
    return nodes.filter(in_range(start, end) & fits)


def query_lod(pyramid: Pyramid, start: int | None = None, end: int | None = None,
              resolution: int | None = None, ranges: DataFrame | None = None,
              look_ahead: bool = False) -> DataFrame:
    """Rows ``(series, is_leaf, min_t, max_t, <state>)`` covering a time range, all times without ``start`` or ``end``.

    Nodes no longer than ``resolution`` are returned whole as aggregates; where level 0 is coarser than
    that, raw points with ``start <= t <= end``. The range is one for all series, or a row per series in
    ``ranges (series, start, end, resolution)``, whose columns then stay in the result.

    ``look_ahead`` first runs a small job over the nodes of a stored pyramid: without leaves to open the
    points are not read at all, few of them are broadcast, and the points' scan gets their time bounds.
    """
    spec = pyramid.spec
    nodes, points, extra = pyramid.nodes, pyramid.points, []
    if ranges is None and resolution is None:
        raise ValueError("a range query needs a resolution, or a table of ranges")
    start, end = (EARLIEST if start is None else start), (LATEST if end is None else end)
    if ranges is not None:
        extra = ["start", "end", "resolution"]
        if look_ahead:  # one range around all, for the scan
            around = ranges.agg(F.min("start").alias("start"), F.max("end").alias("end")).first()
            if around["start"] is not None:
                nodes = nodes.filter(in_range(around["start"], around["end"]))
        nodes, points = nodes.join(ranges, "series"), points.join(ranges, "series")
        start, end, resolution = (F.col(c) for c in extra)

    value = [F.lit(None).cast(points.schema["v"].dataType).alias("v")] if spec.keep_value else []
    whole = coarse_nodes(nodes, start, end, resolution).select(
        "series", F.lit(False).alias("is_leaf"), "min_t", "max_t", *spec.state, *value, *extra)

    span = F.col("max_t") - F.col("min_t")
    leaves = nodes.filter(F.col("level") == 0).filter(in_range(start, end) & (span > resolution))
    open_leaves = leaves.select("series", "node_id")
    if look_ahead:
        seen = leaves.agg(F.count(F.lit(1)).alias("n"), F.min("min_t").alias("low"), F.max("max_t").alias("high")).first()
        if seen["n"] == 0:
            return whole
        points = points.filter(F.col("t").between(seen["low"], seen["high"]))
        if seen["n"] <= FEW_LEAVES:
            open_leaves = F.broadcast(open_leaves)
    raw = points.filter(F.col("t").between(start, end)).join(open_leaves, ["series", "node_id"], "left_semi")
    return whole.unionByName(lift_points(raw, spec, *extra))
