"""Kinds whose state takes two functions: points in time, and nodes by several of their columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.model import AggregateSpec, Columns


def _zero_sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


#: The value that a point has until the next one, weighed by how long: ``mean`` is exact for any set of points or nodes, since
#: a stretch belongs to the point it begins with. The last point of a series has none; alone, its mean is null.
TIME_WEIGHTED = AggregateSpec(
    kind="time_weighted",
    ahead=("t",),
    from_points=lambda c: {"n": F.count(F.lit(1)), "held_ms": F.coalesce(F.sum(c("next_t") - c("t")), F.lit(0)),
                           "area": _zero_sum(c("v") * (c("next_t") - c("t")))},
    from_nodes=lambda c: {"n": F.sum("n"), "held_ms": F.sum("held_ms"), "area": F.sum("area")},
    finals={"mean": lambda c: F.when(c("held_ms") > 0, c("area") / c("held_ms"))})

#: The first and the last value, and how much there is between them.
ENDS = AggregateSpec(
    kind="ends",
    from_points=lambda c: {"n": F.count(F.lit(1)), "first_v": F.min_by("v", "t"), "last_v": F.max_by("v", "t")},
    from_nodes=lambda c: {"n": F.sum("n"), "first_v": F.min_by("first_v", "min_t"), "last_v": F.max_by("last_v", "max_t")},
    finals={"change": lambda c: c("last_v") - c("first_v")})


def trend(origin: int = 0, unit_ms: int = 3_600_000) -> AggregateSpec:
    """Mean, variance and slope (per ``unit_ms``) of values over time, by sums of squares about means.

    Times count from ``origin``; one inside the data keeps the digits that times since 1970 would lose.
    """
    def at(c: Columns) -> Column:
        return (c("t") - F.lit(origin)).cast("double") / F.lit(float(unit_ms))

    def from_points(c: Columns) -> Mapping[str, Column]:
        n = F.count(F.lit(1))
        return {"n": n, "mean_x": F.avg(at(c)), "mean_v": F.avg("v"), "xx": F.var_pop(at(c)) * n, "vv": F.var_pop("v") * n,
                "xv": F.covar_pop(at(c), c("v")) * n}

    def from_nodes(c: Columns) -> Mapping[str, Column]:
        n = F.sum("n")

        def between(a: str, b: str) -> Column:  # of the nodes' means about the mean of all
            return F.sum(c("n") * c(a) * c(b)) - F.sum(c("n") * c(a)) * F.sum(c("n") * c(b)) / n
        return {"n": n, "mean_x": F.sum(c("n") * c("mean_x")) / n, "mean_v": F.sum(c("n") * c("mean_v")) / n,
                "xx": F.sum("xx") + between("mean_x", "mean_x"), "vv": F.sum("vv") + between("mean_v", "mean_v"),
                "xv": F.sum("xv") + between("mean_x", "mean_v")}

    return AggregateSpec(
        kind=f"trend:{origin}:{unit_ms}", from_points=from_points, from_nodes=from_nodes,
        finals={"variance": lambda c: c("vv") / c("n"), "slope": lambda c: F.when(c("xx") > 0, c("xv") / c("xx"))})


#: Rank error of a quantile with this size: below 1 % in 19 of 20 cases. Standard error of a distinct count: 1.04 / 2^(bits / 2).
QUANTILE_K, DISTINCT_BITS = 400, 13


def sketches(k: int = QUANTILE_K, bits: int = DISTINCT_BITS) -> AggregateSpec:
    """Distinct values and quantiles of numeric points, as sketches of a bounded size that nodes merge."""
    return AggregateSpec(
        kind=f"sketches:{k}:{bits}",
        from_points=lambda c: {"n": F.count(F.lit(1)), "values": F.hll_sketch_agg(c("v").cast("string"), F.lit(bits)),
                               "ranks": F.kll_sketch_agg_double(c("v"), F.lit(k))},
        from_nodes=lambda c: {"n": F.sum("n"), "values": F.hll_union_agg(c("values")),
                              "ranks": F.kll_merge_agg_double(c("ranks"), F.lit(k))},
        finals={"n_distinct": lambda c: F.hll_sketch_estimate(c("values")), "median": lambda c: quantile(c("ranks"), 0.5)})


def quantile(ranks: Column, share: float) -> Column:
    """A value that about ``share`` of the values are not above, from the sketch ``ranks``."""
    return F.kll_sketch_get_quantile_double(ranks, F.lit(share))
