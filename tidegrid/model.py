"""Schemas and the aggregate kinds.

Points are rows ``(series, t, v)`` with ``t`` in epoch milliseconds, strictly increasing inside a series.
Nodes are rows ``(series, level, node_id, min_t, max_t, <state>)``; a range query returns rows
``(series, is_leaf, min_t, max_t, <state>)``. The state columns come from the series' kind.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.scan import SLAB_BITS, next_after, ordered_scan

POINTS_NUM = "series STRING, t BIGINT, v DOUBLE"
POINTS_ARR = "series STRING, t BIGINT, v ARRAY<DOUBLE>"
POINTS_STR = "series STRING, t BIGINT, v STRING"
NODES_NUM = ("series STRING, level INT, node_id BIGINT, min_t BIGINT, max_t BIGINT, "
             "lo DOUBLE, hi DOUBLE, n BIGINT, total DOUBLE")
CATALOG = "series STRING, kind STRING, n_submitted BIGINT, n_points BIGINT, min_t BIGINT, max_t BIGINT"
NODES_STR = ("series STRING, level INT, node_id BIGINT, min_t BIGINT, max_t BIGINT, "
             "n BIGINT, summary STRING")


Columns = Callable[[str], Column]


@dataclass(frozen=True)
class AggregateSpec:
    """A mergeable aggregate made of native expressions, in one of two forms.

    The short form: ``lift`` gives the state of one point from its value, ``merge`` aggregates each state column by itself.
    Aggregating points is merging their lifted states, so Spark combines map-side in both cases.

    The form of two functions: ``from_points`` and ``from_nodes`` map state columns to aggregates over the points (``t``, ``v``
    and what ``ahead`` adds) and over states (all state columns, ``min_t`` and ``max_t``). Either may read several columns.
    Nodes are merged in no order, and an aggregate of one part must be the part. ``ahead`` names columns of a point whose value
    at the next point of the series is wanted, as ``next_<name>``, null at the last one.

    ``finals`` are columns computed from a state when it is read. ``keep_value`` keeps the raw value
    of single points next to the state, for kinds whose state does not determine it.
    ``parse`` turns a text cell into a value, null when it cannot be read.
    """

    kind: str
    lift: Callable[[Column], Mapping[str, Column]] | None = None
    merge: Mapping[str, Callable[[Column], Column]] | None = None
    finals: Mapping[str, Callable[[Columns], Column]] = field(default_factory=dict)
    keep_value: bool = False
    parse: Callable[[Column], Column] | None = None
    from_points: Callable[[Columns], Mapping[str, Column]] | None = None
    from_nodes: Callable[[Columns], Mapping[str, Column]] | None = None
    ahead: Sequence[str] = ()

    def __post_init__(self) -> None:
        short, two = (self.lift, self.merge), (self.from_points, self.from_nodes)
        if (None in short) == (None in two) or any(x is not None for x in (short if None in short else two)):
            raise ValueError(f"{self.kind} needs either lift and merge or from_points and from_nodes")
        if self.ahead and self.from_points is None:
            raise ValueError(f"{self.kind} looks ahead, which needs from_points")

    def check(self) -> None:
        """Both functions must name the same columns."""
        names = self.lift(F.col("v")) if self.lift else self.from_points(F.col)
        if set(names) != set(self.state):
            raise ValueError(f"the two functions of {self.kind} name different columns")

    @property
    def state(self) -> list[str]:
        return list(self.merge if self.from_nodes is None else self.from_nodes(F.col))

    def lifted(self, value: Column) -> list[Column]:
        return [expr.alias(name) for name, expr in self.lift(value).items()]

    def merged(self) -> list[Column]:
        if self.from_nodes is not None:
            return [agg.alias(name) for name, agg in self.from_nodes(F.col).items()]
        return [agg(F.col(name)).alias(name) for name, agg in self.merge.items()]

    def prepared(self, points: DataFrame, bits: int = SLAB_BITS) -> DataFrame:
        """``points`` with the columns of ``ahead``, found by one ordered scan unless they are there."""
        missing = {f"next_{c}": next_after(F.col(c)) for c in self.ahead if f"next_{c}" not in points.columns}
        return ordered_scan(points, ["series"], "t", missing, bits) if missing else points

    def of_points(self, points: DataFrame, *keys: str, spans: bool = True, count: str | None = None) -> DataFrame:
        """The state of the points of each combination of ``keys``, with their span and, named ``count``, their number."""
        spanned = [F.min("t").alias("min_t"), F.max("t").alias("max_t")] if spans else []
        counted = [F.count(F.lit(1)).alias(count)] if count else []
        if self.from_points is None:
            rows = points.select(*keys, *(["t"] if spans and "t" not in keys else []), *self.lifted(F.col("v")))
            return rows.groupBy(*keys).agg(*spanned, *self.merged(), *counted)
        states = [agg.alias(name) for name, agg in self.from_points(F.col).items()]
        return self.prepared(points).groupBy(*keys).agg(*spanned, *states, *counted)

    def needs_no_next(self, what: str) -> None:
        if self.ahead:
            raise ValueError(f"{self.kind} looks at the next point, which {what} cannot know")

    def with_finals(self, df: DataFrame) -> DataFrame:
        return df.withColumns({name: fn(F.col) for name, fn in self.finals.items()})


def _one() -> Column:
    return F.lit(1).cast("long")


def _common_text(c: Column) -> Column:
    """The text all rows share; none if two differ or one row has none."""
    return F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.min(c))


_SPREAD = {"lo": F.min, "hi": F.max, "n": F.sum, "total": F.sum}
_MEAN = {"mean": lambda c: c("total") / c("n")}

NUM = AggregateSpec(
    kind="num",
    lift=lambda v: {"lo": v, "hi": v, "n": _one(), "total": v},
    merge=_SPREAD, finals=_MEAN,
    parse=lambda c: c.try_cast("double"))

ARR = AggregateSpec(
    kind="arr",
    lift=lambda v: {"lo": F.array_min(v), "hi": F.array_max(v), "n": F.size(v).cast("long"),
                    "total": F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)},
    merge=_SPREAD, finals=_MEAN, keep_value=True)

STR = AggregateSpec(
    kind="str",
    lift=lambda v: {"n": _one(), "summary": v},
    merge={"n": F.sum, "summary": _common_text},
    parse=lambda c: c)

KINDS: dict[str, AggregateSpec] = {"num": NUM, "arr": ARR, "str": STR}


def register_kind(spec: AggregateSpec) -> AggregateSpec:
    """Add a user-defined kind, usable wherever a spec or a kind name is taken."""
    spec.check()
    KINDS[spec.kind] = spec
    return spec


def spec_of(kind: str | AggregateSpec) -> AggregateSpec:
    return kind if isinstance(kind, AggregateSpec) else KINDS[kind]


def lift_points(points: DataFrame, kind: str | AggregateSpec, *extra: str) -> DataFrame:
    """Points as rows of a range query: one leaf row per point."""
    spec = spec_of(kind)
    kept = [F.col("v")] if spec.keep_value else []
    if spec.from_points is not None:  # aggregates have no form for one value: each point is a group of its own
        value = [F.first("v").alias("v")] if spec.keep_value else []
        states = [agg.alias(name) for name, agg in spec.from_points(F.col).items()]
        own = spec.prepared(points).groupBy("series", "t", *extra).agg(*states, *value)
        return own.select("series", F.lit(True).alias("is_leaf"), F.col("t").alias("min_t"), F.col("t").alias("max_t"),
                          *spec.state, *kept, *extra)
    return points.select("series", F.lit(True).alias("is_leaf"), F.col("t").alias("min_t"),
                         F.col("t").alias("max_t"), *spec.lifted(F.col("v")), *kept, *extra)


def idiv(a: Column, b: Column | int) -> Column:
    """Integer division."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def floor_to(t: Column, width: Column | int) -> Column:
    """The largest multiple of ``width`` not above ``t``, also for negative times."""
    return t - F.pmod(t, width if isinstance(width, Column) else F.lit(width).cast("long"))
