"""Merging overlapping intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.scan import (SLAB_BITS, max_all, max_before, next_after, ordered_scan, total_all,
                                     total_before)
from tidegrid.session import materialize


def merge_intervals(intervals: DataFrame, bits: int = SLAB_BITS) -> DataFrame:
    """Group intervals ``(series, min_t, max_t)`` that overlap; touching ends do not count.

    Returns ``(series, min_t, max_t, n)`` per group. Intervals of one start overlap each other, so they
    are reduced first; one without length overlaps only what it lies strictly inside of, and equal
    copies of it are one group. The first interval of every group is written to the shared folder; a
    group ends where the intervals before the next group's first one reach.
    """
    # at most two rows per start, the one without length first: a unique order
    has_length = (F.col("max_t") > F.col("min_t")).cast("long")
    rows = intervals.select("series", (F.col("min_t") * 2 + has_length).alias("_at"), "max_t")
    reduced = rows.groupBy("series", "_at").agg(F.max("max_t").alias("max_t"), F.count(F.lit(1)).alias("n"))
    reach, n = F.col("max_t"), F.col("n")
    seen = ordered_scan(reduced, ["series"], "_at", {
        "_reach": max_before(reach), "_before": total_before(n), "_top": max_all(reach), "_all": total_all(n)},
        bits, source=rows.withColumn("n", F.lit(1).cast("long")))
    seen = seen.withColumn("min_t", F.shiftright("_at", 1)).drop("max_t", "n")
    firsts = materialize(seen.filter(F.col("_reach").isNull() | (F.col("min_t") >= F.col("_reach"))), "firsts")

    ended = ordered_scan(firsts, ["series"], "_at", {
        "_end": next_after(F.col("_reach")), "_through": next_after(F.col("_before"))}, bits)
    end, count = F.coalesce("_end", "_top"), F.coalesce("_through", "_all")
    return ended.select("series", "min_t", end.alias("max_t"), (count - F.col("_before")).alias("n"))
