"""The viewport query: range, resolution, resample, sections."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidegrid.operators.lod import query_lod
from tidegrid.operators.pyramid import Pyramid
from tidegrid.operators.resample import PX_PER_POINT, min_resolution, resample
from tidegrid.operators.scan import SLAB_BITS
from tidegrid.operators.sections import BREAK_MS, section_by_gap
from tidegrid.session import materialize


@dataclass(frozen=True)
class Viewport:
    """A time range shown ``width_px`` wide, cut at gaps longer than ``gap_ms``."""

    start: int
    end: int
    width_px: int
    gap_ms: int = BREAK_MS

    @property
    def resolution(self) -> int:
        return int((self.end - self.start) / self.width_px * PX_PER_POINT)


WIDEST_PX = 1 << 20


def _cut(resampled: DataFrame, width_px: int, gap_ms: int) -> DataFrame:
    """Sections of resampled rows. A row is shorter than two buckets and a view has ``width_px / 3`` of them,
    so a series has at most two rows per bucket however many points it holds: one window will do.
    """
    return section_by_gap(resampled, gap_ms, bits=None if width_px <= WIDEST_PX else SLAB_BITS)


def choose(pyramid: Pyramid, series: Sequence[str]) -> Pyramid:
    """The pyramid of some series only; the filter reaches the stored files."""
    mine = F.col("series").isin(*series)
    return replace(pyramid, points=pyramid.points.filter(mine), nodes=pyramid.nodes.filter(mine))


def view(pyramid: Pyramid, port: Viewport) -> DataFrame:
    """Sectioned rows of every series for one shared time range, from a stored pyramid."""
    rows = query_lod(pyramid, port.start, port.end, port.resolution, look_ahead=True)
    return _cut(resample(rows, port.resolution, pyramid.spec), port.width_px, port.gap_ms)


def view_ranges(pyramid: Pyramid, ranges: DataFrame, width_px: int, gap_ms: int = BREAK_MS) -> DataFrame:
    """``view`` with a range per series, from ``ranges (series, start, end)``."""
    ranges = ranges.select("series", "start", "end",
                           min_resolution(F.col("start"), F.col("end"), width_px).alias("resolution"))
    rows = query_lod(pyramid, ranges=ranges, look_ahead=True)
    resampled = resample(rows, F.col("resolution"), pyramid.spec, ["series", "resolution"])
    return _cut(resampled.drop("resolution"), width_px, gap_ms)


def view_metrics(pyramid: Pyramid, port: Viewport) -> DataFrame:
    """Rows after each stage of ``view`` per series."""
    rows = query_lod(pyramid, port.start, port.end, port.resolution)
    nodes = rows.groupBy("series").agg(F.count(F.lit(1)).alias("n_nodes"))
    shown = view(pyramid, port).groupBy("series").agg(
        F.count(F.lit(1)).alias("n_resampled"), (F.max("section_id") + 1).alias("n_sections"))
    return nodes.join(shown, "series")


@dataclass(frozen=True)
class Stage:
    name: str
    rows: int
    seconds: float


def timed_view(pyramid: Pyramid, port: Viewport) -> tuple[DataFrame, list[Stage]]:
    """Run ``view`` stage by stage, each written to the shared folder, with row counts and times."""
    steps = {"range": lambda _: query_lod(pyramid, port.start, port.end, port.resolution, look_ahead=True),
             "resample": lambda rows: resample(rows, port.resolution, pyramid.spec),
             "section": lambda rows: _cut(rows, port.width_px, port.gap_ms)}
    rows, stages = None, []
    for name, step in steps.items():
        seen, began = Observation(f"view_{name}"), time.monotonic()
        rows = materialize(step(rows).observe(seen, F.count(F.lit(1)).alias("rows")), f"view-{name}")
        stages.append(Stage(name, seen.get["rows"], time.monotonic() - began))
    return rows, stages


class ViewCache:
    """Keeps the rows of the latest viewport and series until others are asked for."""

    def __init__(self, pyramid: Pyramid) -> None:
        self._pyramid = pyramid
        self._asked: tuple[Viewport, frozenset[str] | None] | None = None
        self._rows: DataFrame | None = None

    def get(self, port: Viewport, series: Sequence[str] | None = None) -> DataFrame:
        asked = port, None if series is None else frozenset(series)
        if asked != self._asked:
            self.clear()
            chosen = self._pyramid if series is None else choose(self._pyramid, series)
            self._rows = view(chosen, port).persist(StorageLevel.MEMORY_AND_DISK)
            self._asked = asked
        return self._rows

    def clear(self) -> None:
        if self._rows is not None:
            self._rows.unpersist()
        self._asked = self._rows = None
