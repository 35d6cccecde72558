"""Ordered scans over series of any size.

A window partitioned by series puts a whole series into one task. Here every series is cut into slabs of
its order column (``order >> SLAB_BITS``). The order column is unique inside a series, so a slab holds at
most ``2**SLAB_BITS`` rows however large the series or however dense a stretch of it is. A scan then is

1. one summary row per slab, from a partial aggregation of only the columns it needs,
2. a window over the summaries of a series (as many rows as the series spans slabs, which grows with
   the time it covers and not with its points; a slab of milliseconds is 70 minutes wide),
3. a window inside each slab, joined with what the slab carries in.

The slab is a function of the row alone, so retried tasks and separately planned branches always agree.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidegrid.functions.scalars import holds

SLAB_BITS = 22

Row = Mapping[str, Column]


@dataclass(frozen=True)
class Carry:
    """A value each row gets from the other rows of its series.

    ``sum``: total of the earlier rows. ``max``: largest of the earlier rows. ``last``: latest non-null
    of the earlier rows. ``next``: first non-null of the later rows. ``all`` and ``top``: total and
    largest of the whole series.
    """

    kind: str
    value: Column


def total_before(value: Column) -> Carry:
    return Carry("sum", value)


def max_before(value: Column) -> Carry:
    return Carry("max", value)


def last_before(value: Column) -> Carry:
    return Carry("last", value)


def next_after(value: Column) -> Carry:
    return Carry("next", value)


def total_all(value: Column) -> Carry:
    return Carry("all", value)


def max_all(value: Column) -> Carry:
    return Carry("top", value)


def ordered(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``df``, which fails where a row has no key or no order: it has no place in its series, and no query drops it unseen."""
    there = F.col(order).isNotNull()
    for c in keys:
        there = there & F.col(c).isNotNull()
    return df.filter(holds(there, F.lit(f"a row without {' or '.join([*keys, order])} has no place in a series")))


def slab_of(order: Column, bits: int = SLAB_BITS) -> Column:
    return F.shiftright(order, bits)


def _summary(carry: Carry, order: Column) -> Column:
    at = F.when(carry.value.isNotNull(), order)
    return {"sum": lambda: F.sum(carry.value), "all": lambda: F.sum(carry.value),
            "max": lambda: F.max(carry.value), "top": lambda: F.max(carry.value), "last": lambda: F.max_by(carry.value, at),
            "next": lambda: F.min_by(carry.value, at)}[carry.kind]()


def _windowed(kind: str, value: Column, keys: Sequence[str], order: Column) -> Column:
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    after = whole.orderBy(order.desc()).rowsBetween(Window.unboundedPreceding, -1)
    return {"sum": lambda: F.coalesce(F.sum(value).over(before), F.lit(0).cast("long")),
            "all": lambda: F.sum(value).over(whole),
            "top": lambda: F.max(value).over(whole),
            "max": lambda: F.max(value).over(before),
            "last": lambda: F.last(value, ignorenulls=True).over(before),
            "next": lambda: F.last(value, ignorenulls=True).over(after)}[kind]()


def _combined(kind: str, local: Column | None, carried: Column) -> Column:
    return {"sum": lambda: local + carried, "all": lambda: carried, "top": lambda: carried,
            "max": lambda: F.greatest(local, carried), "last": lambda: F.coalesce(local, carried),
            "next": lambda: F.coalesce(local, carried)}[kind]()


def ordered_scan(df: DataFrame, keys: Sequence[str], order: str, carries: Mapping[str, Carry],
                 bits: int = SLAB_BITS, source: DataFrame | None = None) -> DataFrame:
    """Add one column per carry. ``order`` is a BIGINT column, unique inside ``keys``.

    ``source`` may give rows of the same columns that sum up to the same per slab and are cheaper to compute.
    """
    keys, at = list(keys), F.col(order)
    df = ordered(df, keys, order)
    slab = slab_of(at, bits).alias("_slab")
    summaries = (df if source is None else source).groupBy(*keys, slab).agg(*[_summary(c, at).alias(f"_s_{n}") for n, c in carries.items()])
    carried = summaries.select(*keys, "_slab", *[
        _windowed(c.kind, F.col(f"_s_{n}"), keys, F.col("_slab")).alias(f"_c_{n}") for n, c in carries.items()])

    in_slab = [*keys, "_slab"]
    local = {n: c for n, c in carries.items() if c.kind not in ("all", "top")}
    scanned = df.withColumn("_slab", slab).withColumns(
        {f"_l_{n}": _windowed(c.kind, c.value, in_slab, at) for n, c in local.items()})
    joined = scanned.join(carried, in_slab)
    return joined.select(*df.columns, *[
        _combined(c.kind, F.col(f"_l_{n}") if n in local else None, F.col(f"_c_{n}")).alias(n)
        for n, c in carries.items()])


def split_by(df: DataFrame, keys: Sequence[str], order: str, needs: Sequence[str],
             rule: Callable[[Row, Row], Column], group: str, bits: int | None = SLAB_BITS) -> DataFrame:
    """Cut every ordered series into groups numbered from 0 in column ``group``.

    ``rule(prev, cur)`` says whether ``cur`` starts a new group; both map the column names in ``needs``
    to columns. The first row of a series never starts another group. The number a row gets is the
    count of starts before it in its slab plus what the earlier slabs carry in. With ``bits`` None a
    series is one slab, for rows whose number per series has a known bound.
    """
    keys, at, in_slab = list(keys), F.col(order), [*list(keys), "_slab"]
    df = ordered(df, keys, order)
    cur = {c: F.col(c) for c in needs}

    def starts(p: Row, c: Row) -> Column:
        return F.coalesce(rule(p, c), F.lit(False)).cast("long")

    def flagged(frame: DataFrame, w: WindowSpec) -> DataFrame:
        frame = frame.withColumns({f"_p_{c}": F.lag(c).over(w) for c in needs})
        frame = frame.withColumn("_first", F.row_number().over(w) == 1)
        return frame.withColumn("_start", F.when(F.col("_first"), F.lit(0).cast("long")).otherwise(
            starts({c: F.col(f"_p_{c}") for c in needs}, cur)))

    if bits is None:
        w = Window.partitionBy(*keys).orderBy(at)
        number = F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return flagged(df, w).select(*df.columns, number.alias(group))

    w = Window.partitionBy(*in_slab).orderBy(at)
    slab = slab_of(at, bits)
    slim = list(dict.fromkeys([*keys, order, *needs]))
    edges = flagged(df.select(*slim, slab.alias("_slab")), w).groupBy(*in_slab).agg(
        F.sum("_start").alias("_inner"),
        *[F.min_by(c, at).alias(f"_f_{c}") for c in needs],
        *[F.max_by(c, at).alias(f"_e_{c}") for c in needs])
    slabs = Window.partitionBy(*keys).orderBy("_slab")
    edges = edges.withColumns({f"_e_{c}": F.lag(f"_e_{c}").over(slabs) for c in needs})
    edges = edges.withColumn("_edge", F.when(F.row_number().over(slabs) == 1, F.lit(0).cast("long")).otherwise(
        starts({c: F.col(f"_e_{c}") for c in needs}, {c: F.col(f"_f_{c}") for c in needs})))
    carried = edges.select(*in_slab, (
        F.sum(F.col("_edge")).over(slabs)
        + F.coalesce(F.sum("_inner").over(slabs.rowsBetween(Window.unboundedPreceding, -1)),
                     F.lit(0).cast("long"))).alias("_base"))

    local = F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = flagged(df.withColumn("_slab", slab), w).withColumn("_local", local).join(carried, in_slab)
    return numbered.select(*df.columns, (F.col("_base") + F.col("_local")).alias(group))
