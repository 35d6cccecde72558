"""Cutting ordered rows into sections and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.scan import SLAB_BITS, split_by

BREAK_MS = 5500  # default gap between sections


def section_by_gap(rows: DataFrame, gap: int = BREAK_MS, keys: Sequence[str] = ("series",),
                   bits: int | None = SLAB_BITS) -> DataFrame:
    """Add ``section_id``: a row that begins more than ``gap`` ms after the end of the previous one
    starts a new section. ``rows`` have distinct ``min_t`` inside a series; they are read twice, the
    first time for the key and time columns only, so write them first if they are costly to compute.
    """
    return split_by(rows, keys, "min_t", ["min_t", "max_t"],
                    lambda prev, cur: cur["min_t"] > prev["max_t"] + gap, "section_id", bits)


def section_bounds(sectioned: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Start, end and number of rows of every section."""
    return sectioned.groupBy(*keys, "section_id").agg(
        F.min("min_t").alias("min_t"), F.max("max_t").alias("max_t"), F.count(F.lit(1)).alias("n_rows"))


def runs_by_kind(sectioned: DataFrame, bits: int | None = SLAB_BITS) -> DataFrame:
    """Add ``run_id``: maximal runs of aggregates or of raw points inside a section."""
    return split_by(sectioned, ["series", "section_id"], "min_t", ["is_leaf"],
                    lambda prev, cur: cur["is_leaf"] != prev["is_leaf"], "run_id", bits)
