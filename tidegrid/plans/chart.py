"""Chart-ready tables: what a plot of a sectioned result draws."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.calendar import best_scale, context_scale, finer_scale
from tidegrid.functions.scalars import holds
from tidegrid.model import idiv

TICK_PX = 64  # at most one tick per this many pixels


@dataclass(frozen=True)
class Frame:
    """Pixel size and the time and value ranges shown in it."""

    width: int
    height: int
    x_min: int
    x_max: int
    y_min: float
    y_max: float

    def x_px(self, t: Column) -> Column:
        return (t - self.x_min) * F.lit(self.width / (self.x_max - self.x_min))

    def y_px(self, v: Column) -> Column:
        return (F.lit(float(self.y_max)) - v) * F.lit(self.height / (self.y_max - self.y_min))

    def time_at(self, px: Column) -> Column:
        """The time under a pixel, truncated to whole ms from the left edge."""
        return (px / F.lit(self.width / (self.x_max - self.x_min))).cast("long") + self.x_min


def band_table(runs: DataFrame) -> DataFrame:
    """Low, high and mean of every aggregate at the middle of its span, by section and run."""
    return runs.filter(~F.col("is_leaf")).select(
        "series", "section_id", "run_id", idiv(F.col("max_t") + F.col("min_t"), 2).alias("t"),
        "lo", "hi", (F.col("total") / F.col("n")).alias("mean"))


def line_table(runs: DataFrame) -> DataFrame:
    """Every raw numeric point, by section and run."""
    return runs.filter("is_leaf").select("series", "section_id", "run_id", F.col("min_t").alias("t"),
                                         F.col("total").alias("v"))


def array_lines(points: DataFrame) -> DataFrame:
    """One line per array element: ``(series, line, n_lines, t, v)``."""
    return points.select("series", "t", F.size("v").alias("n_lines"), F.posexplode("v").alias("line", "v"))


def to_view(table: DataFrame, frame: Frame, t: str = "t", v: str = "v") -> DataFrame:
    """Pixel position of every row."""
    return table.withColumns({"x_px": frame.x_px(F.col(t)), "y_px": frame.y_px(F.col(v))})


def axis_scales(spans: DataFrame, width_px: int) -> DataFrame:
    """Tick, context and cursor scale for ranges ``(start, end)`` shown ``width_px`` wide."""
    span = (F.lit(TICK_PX) / (F.lit(float(width_px)) / (F.col("end") - F.col("start")))).cast("long")
    scaled = spans.withColumn("tick_scale", best_scale(span))
    return scaled.withColumns({"context_scale": context_scale(F.col("tick_scale")),
                               "finer_scale": finer_scale(F.col("tick_scale"))})


def overlay(catalog: DataFrame, series: Sequence[str], strict: bool = True) -> DataFrame:
    """The named series of a catalog that go into one view: those of the first one's kind.

    A series of another kind fails the query, or gets ``accepted`` false unless ``strict``.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in series]), F.col("series"))
    named = Window.orderBy("_place")  # as many rows as names were given
    chosen = catalog.filter(F.col("series").isin(*series)).withColumn("_place", place)
    chosen = chosen.withColumn("accepted", F.col("kind") == F.first("kind").over(named))
    if strict:
        message = F.concat(F.lit("cannot overlay a series of kind "), F.col("kind"), F.lit(": "), F.col("series"))
        chosen = chosen.filter(holds(F.col("accepted"), message))
    return chosen.drop("_place")
