"""Nearest interval, nearest value and cursor readout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.scan import SLAB_BITS, last_before, next_after, ordered_scan
from tidegrid.session import materialize

CURSOR_SNAP_PX = 16  # how far a cursor snaps


def snap_tolerance(start: Column, end: Column, width_px: Column | int, snap_px: int = CURSOR_SNAP_PX) -> Column:
    """The time in ms that ``snap_px`` pixels cover."""
    width = width_px if isinstance(width_px, Column) else F.lit(width_px)
    return (F.lit(snap_px) / (width.cast("double") / (end - start))).cast("long")


def nearest_interval_join(probes: DataFrame, intervals: DataFrame, tolerance: Column | int,
                          keep: Sequence[str] = (), bits: int = SLAB_BITS) -> DataFrame:
    """Join every probe ``(series, t, ...)`` to the interval containing it, or the nearest one.

    ``intervals (series, min_t, max_t, ...)`` are disjoint inside a series. Adds ``kind`` (contained,
    before or after), ``distance`` and the interval's ``min_t``, ``max_t`` and ``keep`` columns. A tie
    goes to the interval after the probe; a probe without an interval within ``tolerance`` gives no row.

    Distinct probe times and intervals are merged into one ordered sequence and scanned in both
    directions, so neither the tolerance nor the length of an interval multiplies rows. Only the intervals that
    the probes' first and last time and the tolerance allow are read, once, and written to the shared folder; the
    scan carries their times, and the ``keep`` columns are joined to what was found.
    """
    if not isinstance(tolerance, Column):
        asked = probes.agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
        if asked["low"] is not None:
            intervals = intervals.filter((F.col("max_t") >= asked["low"] - tolerance) &
                                         (F.col("min_t") <= asked["high"] + tolerance))
    intervals = materialize(intervals.select("series", "min_t", "max_t", *keep), "intervals")
    # the even order of a time is its interval, the odd one its probe: an interval beginning at t comes first
    begins = intervals.select("series", (F.col("min_t") * 2).alias("_at"), "min_t", "max_t")
    asks = probes.select("series", "t").distinct().select("series", (F.col("t") * 2 + 1).alias("_at"))
    begin, end = F.col("min_t"), F.col("max_t")
    carries = {"_b_min": last_before(begin), "_b_max": last_before(end),
               "_a_min": next_after(begin), "_a_max": next_after(end)}
    scanned = ordered_scan(begins.unionByName(asks, allowMissingColumns=True), ["series"], "_at", carries, bits)
    sides = scanned.filter(F.col("min_t").isNull()).select("series", F.shiftright("_at", 1).alias("t"), *carries)

    limit = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    t = F.col("t")
    before, after = t - F.col("_b_max"), F.col("_a_min") - t
    joined = probes.join(sides, ["series", "t"]).withColumns({
        "_before": F.when(before <= limit, before), "_after": F.when(after <= limit, after)})
    # contained needs no tolerance; otherwise before wins only if strictly closer
    inside = t <= F.col("_b_max")
    kind = (F.when(inside, "contained")
            .when(F.col("_before") < F.col("_after"), "before")
            .when(F.col("_after").isNotNull(), "after")
            .when(F.col("_before").isNotNull(), "before"))
    found = joined.withColumn("kind", kind).filter(F.col("kind").isNotNull())

    def chosen(field: str) -> Column:
        return F.when(F.col("kind") == "after", F.col(f"_a_{field}")).otherwise(F.col(f"_b_{field}"))

    distance = F.when(inside, F.lit(0).cast("long")).when(
        F.col("kind") == "after", F.col("_after")).otherwise(F.col("_before"))
    found = found.select(*probes.columns, "kind", distance.alias("distance"), chosen("min").alias("min_t"),
                         chosen("max").alias("max_t"))
    if not keep:
        return found
    return found.join(intervals.select("series", "min_t", *keep), ["series", "min_t"]).select(*found.columns, *keep)


def nearest_value(probes: DataFrame, sectioned: DataFrame, tolerance: Column | int,
                  state: Sequence[str] = ("n", "total"), bits: int = SLAB_BITS) -> DataFrame:
    """The row of a sectioned result nearest to every probe time, with its section."""
    return nearest_interval_join(probes, sectioned, tolerance, ["section_id", "is_leaf", *state], bits)


def _text(name: Column, value: Column, is_leaf: Column) -> Column:
    return F.when(is_leaf, F.format_string("%s = %.5g", name, value)).otherwise(
        F.format_string("%s = (%.5g)", name, value))


def cursor_readout(probes: DataFrame, sectioned: DataFrame, tolerance: Column | int,
                   kind: str = "num", bits: int = SLAB_BITS) -> DataFrame:
    """Value of every series nearest to the cursor times in ``probes``.

    A raw point gives its value, an aggregate its mean, an array point one row per element. ``label``
    is the name (with the element's index), ``text`` the readout.
    """
    arrays = kind == "arr"
    state = ["n", "total", *(["v"] if arrays else [])]
    near = nearest_value(probes, sectioned, tolerance, state, bits)
    mean = F.col("total") / F.col("n")
    if not arrays:
        read = near.withColumns({"label": F.col("series"),
                                 "value": F.when(F.col("is_leaf"), F.col("total")).otherwise(mean)})
    else:
        whole = F.array(mean)
        read = (near.withColumn("_values", F.when(F.col("is_leaf"), F.col("v")).otherwise(whole))
                .select("*", F.posexplode("_values").alias("_index", "value"))
                .withColumn("label", F.when(F.col("is_leaf"), F.concat("series", F.col("_index").cast("string")))
                            .otherwise(F.col("series"))))
    return read.select(*probes.columns, "section_id", "is_leaf", "label", "value",
                       _text(F.col("label"), F.col("value"), F.col("is_leaf")).alias("text"))


def value_order(readout: DataFrame) -> DataFrame:
    """Readouts with the highest value first."""
    return readout.orderBy(F.col("value").desc(), "label")
