"""Consecutive numbers over a whole table in some order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.session import materialize


def numbered(rows: DataFrame, order: Sequence[str | Column], column: str, name: str) -> DataFrame:
    """``rows`` with ``column``, from 1 in the given order: sorted by ranges and written, then numbered with one count a range.

    No task sees more than its range, and the driver one count for each. ``rows`` may not have columns ``place, part, begin``.
    """
    done = materialize(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), name)
    part = F.shiftright("place", 33)  # the partition, before 33 bits for the row inside it
    sizes = done.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    begins, total = [], 0
    for r in sorted(sizes):
        begins.append((r["part"], total))
        total += r["n"]
    table = done.sparkSession.createDataFrame(begins, "part long, begin long")
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return (done.withColumn("part", part).join(F.broadcast(table), "part")
            .withColumn(column, F.col("begin") + inside + 1).drop("part", "begin", "place"))
