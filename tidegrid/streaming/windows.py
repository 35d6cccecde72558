"""Streaming resample and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.model import AggregateSpec, spec_of


def _timed(points: DataFrame, spec: AggregateSpec, delay_ms: int) -> tuple[DataFrame, list[Column]]:
    """Points with a watermark, and the aggregates over them."""
    spec.needs_no_next("a stream")
    raw = spec.from_points is not None
    rows = points.select("series", "t", F.timestamp_millis("t").alias("ts"), *(["v"] if raw else spec.lifted(F.col("v"))))
    states = [agg.alias(name) for name, agg in spec.from_points(F.col).items()] if raw else spec.merged()
    return rows.withWatermark("ts", f"{delay_ms} milliseconds"), states


def stream_tumble(points: DataFrame, resolution: int, delay_ms: int,
                  kind: str | AggregateSpec = "num") -> DataFrame:
    """State per series and bucket of ``resolution`` ms; a bucket comes out once the watermark passes it."""
    spec = spec_of(kind)
    bucket = F.window("ts", f"{resolution} milliseconds")
    rows, states = _timed(points, spec, delay_ms)
    grouped = rows.groupBy("series", bucket).agg(*states)
    return grouped.select("series", F.unix_millis("window.start").alias("t"), *spec.state)


def stream_sections(points: DataFrame, gap_ms: int, delay_ms: int,
                    kind: str | AggregateSpec = "num") -> DataFrame:
    """Span and state of every section: points at most ``gap_ms`` after the previous one stay together.

    Set ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` to merge sessions before
    the shuffle, so that a large series arrives as few rows.
    """
    spec = spec_of(kind)
    section = F.session_window("ts", f"{gap_ms} milliseconds")
    rows, states = _timed(points, spec, delay_ms)
    grouped = rows.groupBy("series", section).agg(F.min("t").alias("min_t"), F.max("t").alias("max_t"), *states)
    return grouped.select("series", "min_t", "max_t", *spec.state)
