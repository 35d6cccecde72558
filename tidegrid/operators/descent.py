"""Nearest points of a few probes, by descent through a stored pyramid.

A cursor asks for one time in every series shown. From the top node of its series a probe goes down, on each level to the last
node that begins at or before its time and to the first one that begins after it; all that can be nearest lies under these two.
A level reads the children of two nodes a probe, and the points of two leaves, whatever the series holds.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidegrid.operators.pyramid import CountShape, Pyramid

#: Distinct probes that are looked up this way, and ranges of time that a scan is asked for. More are a join's work.
FEW_PROBES, RANGES = 1000, 16


def _collected(rows: DataFrame) -> list[Row]:
    return rows.collect()


def _times(spans: Iterable[tuple[int, int]], low: str, high: str) -> Column:
    """A filter for the scan: rows from ``low`` to ``high`` inside one of at most RANGES ranges that hold all spans."""
    ranges: list[list[int]] = []
    for begin, end in sorted(spans):
        if ranges and begin <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], end)
        else:
            ranges.append([begin, end])
    while len(ranges) > RANGES:
        i = min(range(len(ranges) - 1), key=lambda k: ranges[k + 1][0] - ranges[k][1])
        ranges[i:i + 2] = [[ranges[i][0], ranges[i + 1][1]]]
    inside = ((F.col(low) >= begin) & (F.col(high) <= end) for begin, end in ranges)
    return reduce(Column.__or__, inside)


def _of(rows: DataFrame, nodes: Iterable[Row], columns: list[str], keys: list[tuple], low: str, high: str) -> DataFrame:
    """The rows with one of the ``keys``, all of which lie in the spans of ``nodes``."""
    nodes = list(nodes)
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    wanted = rows.sparkSession.createDataFrame(keys, types)  # two for each probe at most
    near = rows.filter(F.col("series").isin(*sorted({n["series"] for n in nodes})))
    return near.filter(_times(((n["min_t"], n["max_t"]) for n in nodes), low, high)).join(
        F.broadcast(wanted), columns, "left_semi")


def _leaves(pyramid: Pyramid, probes: set[tuple[str, int]]) -> set[Row]:
    """The level-0 nodes that each probe has at its time and after it."""
    series = sorted({s for s, _ in probes})
    columns = ["series", "level", "node_id", "min_t", "max_t"]
    nodes = pyramid.nodes.select(*columns, "parent_id")
    tops = {r["series"]: r for r in _collected(nodes.filter(F.col("parent_id").isNull() & F.col("series").isin(*series)))}
    # (node at or before, node after) of each probe; both lie in one series
    sides: dict[tuple[str, int], tuple[Row | None, Row | None]] = {}
    for s, t in probes:
        if s in tops:
            sides[s, t] = (tops[s], None) if tops[s]["min_t"] <= t else (None, tops[s])
    while True:
        opened = {n for pair in sides.values() for n in pair if n is not None and n["level"] > 0}
        if not opened:
            return {n for pair in sides.values() for n in pair if n is not None}
        # the span of the children is the parent's, so the scan gets their times
        keys = [(n["series"], n["level"] - 1, n["node_id"]) for n in opened]
        wanted = _of(nodes.filter(F.col("level").isin(*sorted({k[1] for k in keys}))), opened, ["series", "level", "parent_id"],
                     keys, "min_t", "max_t")
        children: dict[tuple[str, int, int], list[Row]] = {}
        for r in _collected(wanted):
            children.setdefault((r["series"], r["level"] + 1, r["parent_id"]), []).append(r)
        for (s, t), pair in sides.items():
            below: list[Row] = []
            for n in pair:
                if n is not None:
                    below += children.get((s, n["level"], n["node_id"]), []) if n["level"] > 0 else [n]
            sides[s, t] = (max((n for n in below if n["min_t"] <= t), key=lambda n: n["min_t"], default=None),
                           min((n for n in below if n["min_t"] > t), key=lambda n: n["min_t"], default=None))


def nearest_points(pyramid: Pyramid, probes: DataFrame, tolerance: int) -> DataFrame:
    """The point of its series nearest to every probe ``(series, t, ...)``: ``kind``, ``distance``, ``min_t`` and ``v``.

    ``kind`` is contained for a point at the probe's time, else before or after; the latter wins a tie. A probe without a point
    within ``tolerance`` gives no row. At most ``FEW_PROBES`` different probes; the pyramid is a count-based one.
    """
    if not isinstance(pyramid.shape, CountShape):
        raise ValueError("descent needs a count-based pyramid")
    asked = probes.select("series", "t").distinct()
    few = {(r["series"], r["t"]) for r in _collected(asked.limit(FEW_PROBES + 1))}
    if len(few) > FEW_PROBES:
        raise ValueError(f"more than {FEW_PROBES} probes: use nearest_value")
    leaves = _leaves(pyramid, few) if few else set()
    if not leaves:
        points = pyramid.points.filter(F.lit(False))
    else:
        keys = [(n["series"], n["node_id"]) for n in leaves]
        points = _of(pyramid.points, leaves, ["series", "node_id"], keys, "t", "t")
    found = points.select("series", F.col("t").alias("min_t"), "v")
    at, t = F.struct("min_t", "v"), F.col("t")
    near = asked.join(found, "series").groupBy("series", "t").agg(  # two leaves a probe
        F.max_by(at, F.when(F.col("min_t") <= t, F.col("min_t"))).alias("_b"),
        F.min_by(at, F.when(F.col("min_t") > t, F.col("min_t"))).alias("_a"))
    near = near.withColumn("_b", F.when(F.col("_b.min_t") <= t, F.col("_b"))).withColumn(
        "_a", F.when(F.col("_a.min_t") > t, F.col("_a")))
    before, after = t - F.col("_b.min_t"), F.col("_a.min_t") - t
    near = near.withColumns({"_before": F.when(before <= tolerance, before), "_after": F.when(after <= tolerance, after)})
    kind = (F.when(before == 0, "contained").when(F.col("_before") < F.col("_after"), "before")
            .when(F.col("_after").isNotNull(), "after").when(F.col("_before").isNotNull(), "before"))
    near = near.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    is_after = F.col("kind") == "after"
    chosen = near.select("series", "t", "kind", F.when(is_after, F.col("_after")).otherwise(before).alias("distance"),
                         F.when(is_after, F.col("_a.min_t")).otherwise(F.col("_b.min_t")).alias("min_t"),
                         F.when(is_after, F.col("_a.v")).otherwise(F.col("_b.v")).alias("v"))
    return probes.join(chosen, ["series", "t"]).select(*probes.columns, "kind", "distance", "min_t", "v")
