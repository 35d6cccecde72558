"""Pre-aggregated nodes of every series at many resolutions.

Two shapes share one node table ``(series, level, node_id, min_t, max_t, <state>, parent_id, parent_span)``:
``build_pyramid`` groups consecutive points (level 0) and consecutive nodes (higher levels) by count and
adds ``n_points``, ``build_time_pyramid`` groups by a time grid. ``parent_span`` is stored so that a range
query picks the coarsest fitting nodes with a filter; it is null at the top.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.model import AggregateSpec, floor_to, idiv, spec_of
from tidegrid.operators.points import drop_backward, with_positions
from tidegrid.operators.scan import SLAB_BITS, ordered
from tidegrid.session import materialize

# Most points in a leaf and most children of a node
LEAF_SIZE = 64
FANOUT = 16
MAX_POINTS = 1 << 52  # longest series the level tables cover


def _longs(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{x}L' for x in values)})")


@dataclass(frozen=True)
class CountShape:
    """Which node a position belongs to when groups are split on being full.

    A full group keeps its lower half, so all nodes but the last of a level are half full: level j has
    nodes of ``unit[j]`` points, and a series with at most ``limit[j]`` points has one node there.
    """

    leaf_size: int = LEAF_SIZE
    fanout: int = FANOUT

    def __post_init__(self) -> None:
        if self.leaf_size < 2 or self.fanout < 4:
            raise ValueError("leaf size must be at least 2 and fan-out at least 4")

    @property
    def half(self) -> int:
        return self.fanout // 2

    @property
    def tables(self) -> tuple[list[int], list[int]]:
        unit, limit = [self.leaf_size // 2], [self.leaf_size]
        while limit[-1] < MAX_POINTS:
            limit.append((self.fanout - 1) * unit[-1] + limit[-1])
            unit.append(unit[-1] * self.half)
        return unit, limit

    def _unit(self, level: Column) -> Column:
        return F.element_at(_longs(self.tables[0]), level + 1)

    def _limit(self, level: Column) -> Column:
        return F.element_at(_longs(self.tables[1]), level + 1)

    def top(self, n: Column) -> Column:
        """The level at which a series of ``n`` points has one node."""
        return F.size(F.filter(_longs(self.tables[1]), lambda c: c < n))

    def count(self, n: Column, level: Column) -> Column:
        """How many nodes a series of ``n`` points has on a level."""
        unit, limit = self._unit(level), self._limit(level)
        return F.when(n <= limit, F.lit(1).cast("long")).otherwise(idiv(n - limit + unit - 1, unit) + 1)

    def leaf_of(self, pos: Column, n: Column) -> Column:
        return F.least(idiv(pos, self.leaf_size // 2), self.count(n, F.lit(0)) - 1)

    def ancestor(self, node: Column, below: Column, n: Column, level: Column) -> Column:
        """The node on ``level`` that is or is above ``node`` of level ``below``."""
        return F.least(idiv(node, idiv(self._unit(level), self._unit(below))), self.count(n, level) - 1)

    def parent(self, node: Column, n: Column, level: Column) -> Column:
        return F.when(level < self.top(n), F.least(idiv(node, self.half), self.count(n, level + 1) - 1))


@dataclass(frozen=True)
class GridShape:
    """Level j of a time grid has nodes of ``base_ms * fanout**j`` ms."""

    base_ms: int = 60_000
    fanout: int = FANOUT
    levels: int = 5


@dataclass(frozen=True)
class Pyramid:
    """Points with the level-0 node they are in, the nodes of all levels, and how both were cut."""

    points: DataFrame
    nodes: DataFrame
    spec: AggregateSpec
    shape: CountShape | GridShape


def _cut_by(pyramid: Pyramid, kind: type) -> CountShape | GridShape:
    if not isinstance(pyramid.shape, kind):
        raise ValueError(f"this operation needs a pyramid of {kind.__name__}, not {pyramid.shape}")
    return pyramid.shape


def _grouped(rows: DataFrame, spec: AggregateSpec, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("min_t").alias("min_t"), F.max("max_t").alias("max_t"), *spec.merged())


def _with_parent_span(nodes: DataFrame) -> DataFrame:
    """Span of the parent from its children, of which it has at most the fan-out."""
    w = Window.partitionBy("series", "level", "parent_id")
    span = F.max("max_t").over(w) - F.min("min_t").over(w)
    return nodes.withColumn("parent_span", F.when(F.col("parent_id").isNotNull(), span))


def _leaves(placed: DataFrame, spec: AggregateSpec, *keys: str) -> DataFrame:
    return spec.of_points(placed, *keys, count="n_points").withColumn("level", F.lit(0))


def _counted(rows: DataFrame, spec: AggregateSpec, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("min_t").alias("min_t"), F.max("max_t").alias("max_t"), *spec.merged(),
                                   F.sum("n_points").alias("n_points"))


def _levels(nodes: DataFrame, spec: AggregateSpec, shape: CountShape) -> DataFrame:
    """Nodes of the levels from ``above`` up: every given node is merged into each of its ancestors in one shuffle."""
    n, up = F.col("series_n"), F.col("_up")
    raised = nodes.filter(F.col("above") <= shape.top(n)).withColumn(
        "_up", F.explode(F.sequence(F.col("above"), shape.top(n))))
    raised = raised.withColumn("node_id", shape.ancestor(F.col("node_id"), F.col("level"), n, up))
    return _counted(raised.drop("level").withColumnRenamed("_up", "level"), spec, "series", "series_n", "level", "node_id")


def _with_parents(nodes: DataFrame, shape: CountShape) -> DataFrame:
    parent = shape.parent(F.col("node_id"), F.col("series_n"), F.col("level"))
    return _with_parent_span(nodes.withColumn("parent_id", parent)).drop("series_n")


def place_points(points: DataFrame, shape: CountShape, bits: int = SLAB_BITS) -> DataFrame:
    """Add position, series length and level-0 node to points in strictly increasing time."""
    placed = with_positions(points, bits)
    return placed.withColumn("node_id", shape.leaf_of(F.col("pos"), F.col("series_n")))


def build_pyramid(points: DataFrame, kind: str | AggregateSpec = "num", leaf_size: int = LEAF_SIZE,
                  fanout: int = FANOUT, bits: int = SLAB_BITS) -> Pyramid:
    """The count-based pyramid of points in strictly increasing time."""
    spec, shape = spec_of(kind), CountShape(leaf_size, fanout)
    placed = place_points(spec.prepared(points, bits), shape, bits)
    leaves = _leaves(placed, spec, "series", "series_n", "node_id").withColumn("above", F.lit(0))
    return Pyramid(placed.drop("series_n"), _with_parents(_levels(leaves, spec, shape), shape), spec, shape)


def nodes_of_placed(points: DataFrame, spec: AggregateSpec, shape: CountShape) -> DataFrame:
    """Nodes of all levels from stored points that carry their ``node_id``; no positions are computed again."""
    lengths = points.groupBy("series").agg(F.count(F.lit(1)).alias("series_n"))
    leaves = _leaves(points, spec, "series", "node_id").join(lengths, "series").withColumn("above", F.lit(0))
    return _with_parents(_levels(leaves, spec, shape), shape)


def build_time_pyramid(points: DataFrame, kind: str | AggregateSpec = "num", base_ms: int = 60_000,
                       fanout: int = FANOUT, levels: int = 5) -> Pyramid:
    """The pyramid on a time grid: level j has nodes of ``base_ms * fanout**j`` ms.

    Needs no positions, so it is one partial aggregation of the points and one of the leaves.
    """
    spec = spec_of(kind)
    placed = spec.prepared(ordered(points, ["series"], "t")).withColumn("node_id", idiv(floor_to(F.col("t"), base_ms), base_ms))
    leaves = spec.of_points(placed, "series", "node_id")
    return Pyramid(placed, time_levels(leaves, spec, fanout, levels), spec, GridShape(base_ms, fanout, levels))


def time_levels(leaves: DataFrame, spec: AggregateSpec, fanout: int, levels: int) -> DataFrame:
    """All levels of a time grid from its level-0 nodes."""
    width = F.element_at(_longs([fanout ** j for j in range(levels)]), F.col("level") + 1)
    up = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    up = up.withColumn("node_id", idiv(floor_to(F.col("node_id"), width), width))
    return with_grid_parent(_grouped(up, spec, "series", "level", "node_id"), fanout, levels)


def with_grid_parent(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    parent = F.when(F.col("level") < levels - 1, idiv(floor_to(F.col("node_id"), fanout), fanout))
    return _with_parent_span(nodes.withColumn("parent_id", parent))


def append_time_points(pyramid: Pyramid, points: DataFrame) -> Pyramid:
    """A time-grid pyramid with more points, on its own grid: new nodes merge into the ones they share."""
    spec, shape = pyramid.spec, _cut_by(pyramid, GridShape)
    spec.needs_no_next("a node that is final")
    new = build_time_pyramid(points, spec, shape.base_ms, shape.fanout, shape.levels)
    keys = ["series", "level", "node_id"]
    both = pyramid.nodes.drop("parent_id", "parent_span").unionByName(new.nodes.drop("parent_id", "parent_span"))
    nodes = with_grid_parent(_grouped(both, spec, *keys), shape.fanout, shape.levels)
    return Pyramid(pyramid.points.unionByName(new.points), nodes, spec, shape)


def append_delta(pyramid: Pyramid, points: DataFrame, pos: str, bits: int = SLAB_BITS) -> Pyramid:
    """What later points change in a count-based pyramid: the rows to ``upsert``.

    ``points`` arrive in ``pos`` order; those not later than what their series holds are dropped. All nodes
    but the last of a level are final, and a final node under a final parent stays as it is. So per series
    only the last leaf's points are read again, and a few final nodes per level (those whose parent is
    not final) join the new leaves in making up the rest.
    """
    spec, shape = pyramid.spec, _cut_by(pyramid, CountShape)
    level, old_n = F.col("level"), F.col("old_n")
    held = pyramid.nodes.filter("parent_id is null").select(
        "series", F.col("n_points").alias("old_n"), F.col("max_t").alias("last_t"))
    kept = drop_backward(points, pos, last_times=held.select("series", "last_t"), bits=bits)
    fresh = with_positions(kept.select("series", "t", "v"), bits).join(
        held.drop("last_t"), "series", "left").fillna(0, ["old_n"])
    fresh = materialize(fresh.select("series", "t", "v", (F.col("pos") + old_n).alias("pos"), "old_n",
                                     (F.col("series_n") + old_n).alias("series_n")), "appended")
    grown = fresh.groupBy("series").agg(F.max("old_n").alias("old_n"), F.max("series_n").alias("series_n"))

    def last(j: Column) -> Column:
        return shape.count(old_n, j) - 1

    old = pyramid.nodes.join(grown, "series")
    open_leaves = old.filter((level == 0) & (F.col("node_id") >= last(level)))
    open_from = open_leaves.agg(F.min("min_t")).first()[0]  # one time for the scan to skip what is older
    placed = fresh.select("series", "t", "v", "pos", "series_n")
    if open_from is not None:
        reopened = pyramid.points.filter(F.col("t") >= open_from).join(
            open_leaves.select("series", "node_id", "series_n"), ["series", "node_id"])
        placed = placed.unionByName(reopened.select("series", "t", "v", "pos", "series_n"))
    placed = spec.prepared(placed, bits).withColumn("node_id", shape.leaf_of(F.col("pos"), F.col("series_n")))

    final = F.col("node_id") < last(level)
    under_final = F.coalesce(F.col("parent_id") < last(level + 1), F.lit(False))
    edge = old.filter(final & ~under_final)
    columns = ["series", "series_n", "level", "node_id", "min_t", "max_t", *spec.state, "n_points"]
    parts = (edge.select(*columns, (level + 1).alias("above"))
             .unionByName(_leaves(placed, spec, "series", "series_n", "node_id").withColumn("above", F.lit(0))))
    changed = edge.select(*columns).unionByName(_levels(parts, spec, shape).select(*columns))
    return Pyramid(placed.select(*pyramid.points.columns),
                   _with_parents(changed, shape).select(*pyramid.nodes.columns), spec, shape)


def upsert(pyramid: Pyramid, delta: Pyramid) -> Pyramid:
    """A count-based pyramid with the rows of ``append_delta`` in place of the ones they replace."""
    nodes = pyramid.nodes.join(delta.nodes, ["series", "level", "node_id"], "left_anti").unionByName(delta.nodes)
    replaced = delta.points.groupBy("series").agg(F.min("pos").alias("_from"))
    stay = pyramid.points.join(replaced, "series", "left").filter("_from is null or pos < _from").drop("_from")
    return Pyramid(stay.unionByName(delta.points), nodes, pyramid.spec, pyramid.shape)


def append_points(pyramid: Pyramid, points: DataFrame, pos: str, bits: int = SLAB_BITS) -> Pyramid:
    """A count-based pyramid with later points added; equals building it from all points at once."""
    return upsert(pyramid, append_delta(pyramid, points, pos, bits))


def pyramid_stats(nodes: DataFrame) -> DataFrame:
    """Depth and number of nodes and points per series."""
    return nodes.groupBy("series").agg(
        (F.max("level") + 1).alias("depth"), F.count(F.lit(1)).alias("n_nodes"),
        F.sum(F.when(F.col("level") == 0, F.col("n"))).cast("long").alias("n"))


def validate_pyramid(pyramid: Pyramid) -> DataFrame:
    """Violations ``(series, level, node_id, problem)`` of a count-based pyramid by its own shape; none when it is sound."""
    spec, shape = pyramid.spec, _cut_by(pyramid, CountShape)
    key = ["series", "level", "node_id"]
    state = ["min_t", "max_t", *spec.state]
    rows = pyramid.points.withColumn("level", F.lit(0))
    nodes = pyramid.nodes
    children = nodes.filter("parent_id is not null").select(
        "series", (F.col("level") + 1).alias("level"), F.col("parent_id").alias("node_id"), *state)

    def expected(parts: DataFrame) -> DataFrame:
        return parts.groupBy(*key).agg(F.min("min_t").alias("min_t"), F.max("max_t").alias("max_t"),
                                       *spec.merged(), F.count(F.lit(1)).alias("_size"))

    found = spec.of_points(rows, *key, count="_size").unionByName(expected(children))
    found = found.select(*key, "_size", *[F.col(c).alias(f"_e_{c}") for c in state])
    both = nodes.select(*key, *state, F.lit(True).alias("_stored")).join(found, key, "full")

    def differs(c: str) -> Column:
        if dict(nodes.dtypes)[c] in ("double", "float"):  # sums depend on the order of addition
            gap = F.abs(F.col(c) - F.col(f"_e_{c}"))
            return gap > F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(F.col(c)))
        return ~F.col(c).eqNullSafe(F.col(f"_e_{c}"))

    bounds = differs("min_t") | differs("max_t")
    aggregate = F.lit(False)
    for c in spec.state:
        if dict(nodes.dtypes)[c] != "binary":  # a sketch depends on the order of merging
            aggregate = aggregate | differs(c)
    size = F.col("_size") > F.when(F.col("level") == 0, F.lit(shape.leaf_size)).otherwise(F.lit(shape.fanout))
    problem = (F.when(F.col("_stored").isNull(), "missing").when(F.col("_size").isNull(), "empty")
               .when(bounds, "bounds").when(size, "size").when(F.coalesce(aggregate, F.lit(False)), "aggregate"))
    wrong = both.select(*key, problem.alias("problem")).filter("problem is not null")

    siblings = Window.partitionBy("series", "level", "parent_id").orderBy("min_t")  # at most the fan-out
    order = (nodes.withColumn("_end", F.lag("max_t").over(siblings)).filter(F.col("_end") > F.col("min_t"))
             .select(*key, F.lit("order").alias("problem")))
    return wrong.unionByName(order)
