"""Labels spread out so that none covers another.

Labels that overlap are pooled: a pool is as wide as its labels side by side, centred between the lowest and the highest place
that they ask for, and moved inside the limits if it fits there. Wider pools may meet others, so pooling goes on until none do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalars import holds
from tidegrid.operators.fold import Fold, fold_scan
from tidegrid.operators.scan import SLAB_BITS, max_before, ordered_scan, total_before
from tidegrid.session import materialize


def begins_at(low: float, high: float, count: int, width: float, least: float, most: float) -> float:
    """Where a pool of ``count`` labels begins. A label by itself stays where it asks to be, also over a limit."""
    size = count * width
    if count == 1:
        return low - width / 2
    if size > most - least:  # does not fit: over both limits alike
        return (least + most) / 2 - size / 2
    return min(max((low + high) / 2 - size / 2, least), most - size)


def spread_positions(labels: DataFrame, keys: Sequence[str], order: str, position: str, width: float, least: float,
                     most: float, bits: int = SLAB_BITS) -> DataFrame:
    """``labels`` with ``spread``: the centre of each label of ``width`` on an axis from ``least`` to ``most``.

    ``order`` is a BIGINT column, unique inside ``keys``, in which the positions do not go back; else the query fails. Every round
    is one fold over all axes at once (see ``fold``), on one row for each pool; rounds end when no two pools overlap.
    """
    keys = list(keys)

    def step(state: tuple, row: tuple) -> tuple[tuple, bool]:
        low, high, count = row
        if state[2] == 0:
            return row, True
        mine, other = begins_at(*state, width, least, most), begins_at(*row, width, least, most)
        if mine < other + count * width and other < mine + state[2] * width:
            return (min(state[0], low), max(state[1], high), state[2] + count), False
        return row, True

    rule = Fold(["low", "high", "count"], "p_low DOUBLE, p_high DOUBLE, p_count BIGINT", (0.0, 0.0, 0), step)
    seen = ordered_scan(labels, keys, order, {"_before": max_before(F.col(position)), "_nth": total_before(F.lit(1).cast("long"))},
                        bits)
    back = F.concat(F.lit("positions go back at "), F.col(position).cast("string"))
    seen = seen.filter(holds(F.coalesce(F.col(position) >= F.col("_before"), F.col(position).isNotNull()), back))
    seen = materialize(seen.drop("_before"), "labels")
    at = F.col(position).cast("double")
    pools = seen.select(*keys, F.col(order).alias("_order"), at.alias("low"), at.alias("high"),
                        F.lit(1).cast("long").alias("count"))
    n = pools.count()
    while n:
        folded = fold_scan(pools, keys, "_order", rule, "_pool", bits)
        state = F.max_by(F.struct("p_low", "p_high", "p_count"), "_order").alias("_s")
        pools = materialize(folded.groupBy(*keys, "_pool").agg(F.min("_order").alias("_order"), state).select(
            *keys, "_order", F.col("_s.p_low").alias("low"), F.col("_s.p_high").alias("high"), F.col("_s.p_count").alias("count")),
            "pools")
        left = pools.count()
        if left == n:
            break
        n = left
    first = ordered_scan(pools, keys, "_order", {"_first": total_before(F.col("count"))}, bits)
    each = first.select(*keys, F.posexplode(F.sequence(F.col("_first"), F.col("_first") + F.col("count") - 1)).alias("_i", "_nth"),
                        _begin(width, least, most).alias("_begin"))
    spread = F.col("_begin") + F.lit(width / 2) + F.col("_i") * F.lit(width)
    return seen.join(each.select(*keys, "_nth", spread.alias("spread")), [*keys, "_nth"]).select(*labels.columns, "spread")


def _begin(width: float, least: float, most: float) -> Column:
    """``begins_at`` as a column."""
    size = F.col("count") * F.lit(float(width))
    inside = F.least(F.greatest((F.col("low") + F.col("high")) / 2 - size / 2, F.lit(float(least))), F.lit(float(most)) - size)
    return (F.when(F.col("count") == 1, F.col("low") - F.lit(width / 2))
            .when(size > most - least, F.lit((least + most) / 2) - size / 2).otherwise(inside))
