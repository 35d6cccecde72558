"""Aggregates of two functions: weighed by time, of both ends, trends, sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import aggregates as agg, pyramid as pyr, resample as rs
from tidegrid.operators.kinds import ENDS, TIME_WEIGHTED, sketches, trend
from tidegrid.registry import EVENTS, events, query, rounded
from tidegrid.registry.pyramids import END, RESOLUTION, START, pyramid_sql, stored
from tidegrid.operators.lod import query_lod

HOUR = 3_600_000
# a point's value with the time of the next one
AHEAD = ("ew AS (SELECT series, t, struct_pack(v := v, after := lead(t) OVER (PARTITION BY series ORDER BY t)) AS v FROM ev)")
_HELD = ("count(*) AS n, CAST(coalesce(sum(v.after - t), 0) AS BIGINT) AS held_ms, "
         "round(coalesce(sum(v.v * (v.after - t)), 0.0) / 1000, 2) AS area_s")


@query(f"""WITH {EVENTS}, {AHEAD}
SELECT series, min(t) AS min_t, max(t) AS max_t, count(*) AS n, CAST(sum(v.after - t) AS BIGINT) AS held_ms,
       round(sum(v.v * (v.after - t)) / sum(v.after - t), 6) AS mean FROM ew GROUP BY series""")
def time_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value weighed by how long it lasts, from the points."""
    return rounded(agg.series_summary(events(spark, sf_dir), TIME_WEIGHTED).drop("area"), "mean", places=6)


@query(f"""WITH {EVENTS}, {AHEAD}, {pyramid_sql('ew', 8, 4, _HELD, 'n, held_ms, area_s')}
SELECT series, level, node_id, min_t, max_t, n, held_ms, area_s FROM nd""")
def time_weighted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through all nodes of a stored pyramid."""
    nodes = stored(spark, events(spark, sf_dir), TIME_WEIGHTED, leaf_size=8, fanout=4).nodes
    return rounded(nodes.withColumn("area_s", F.col("area") / 1000), "area_s", places=2).select(
        "series", "level", "node_id", "min_t", "max_t", "n", "held_ms", "area_s")


@query(f"""WITH {EVENTS}
SELECT series, count(*) = 1 AS is_leaf, min(t) AS min_t, max(t) AS max_t, count(*) AS n, arg_min(v, t) AS first_v,
       arg_max(v, t) AS last_v, round(arg_max(v, t) - arg_min(v, t), 6) AS change FROM ev GROUP BY series, t // {HOUR * 6}""")
def resample_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last value of every quarter of a day, merged from those of every hour."""
    hours = rs.resample_points(events(spark, sf_dir), HOUR, ENDS)
    return rounded(ENDS.with_finals(rs.resample(hours, 6 * HOUR, ENDS)), "change", places=6)


@query(f"""WITH {EVENTS}
SELECT series, count(*) AS n, round(var_pop(v), 5) AS variance, round(regr_slope(v, (t - {START}) / {HOUR}.0), 8) AS slope
FROM ev GROUP BY series""")
def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance and slope per hour of every series, merged from the top nodes of its pyramid's time grid."""
    kind = trend(START, HOUR)
    grid = pyr.build_time_pyramid(events(spark, sf_dir), kind, 600_000, 16, 3)
    found = rounded(rounded(agg.series_summary(grid), "variance", places=5), "slope", places=8)
    return found.select("series", "n", "variance", "slope")


@query(f"""WITH {EVENTS}, dy AS (SELECT series, t // {HOUR * 24} AS day, v FROM ev)
SELECT series, day * {HOUR * 24} AS t, count(*) AS n, count(DISTINCT v) AS exact_distinct, true AS distinct_near, true AS median_near
FROM dy GROUP BY series, day""")
def sketched_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every hour merged to days: distinct values within 5 % and one, the median's rank within 3 % and one."""
    kind, points = sketches(), events(spark, sf_dir)
    hours = rs.resample_points(points, HOUR, kind)
    day = F.col("min_t") - F.pmod("min_t", F.lit(HOUR * 24))
    days = kind.with_finals(agg.agg_nodes(hours.withColumn("day", day), kind, ["series", "day"]))
    day_of_point = (F.col("t") - F.pmod("t", F.lit(HOUR * 24))).alias("day")
    both = points.select("series", day_of_point, "v").join(days, ["series", "day"])
    below, upto = F.sum((F.col("v") < F.col("median")).cast("long")), F.sum((F.col("v") <= F.col("median")).cast("long"))
    count, exact = F.count(F.lit(1)), F.count_distinct("v")
    return both.groupBy("series", F.col("day").alias("t")).agg(
        count.alias("n"), exact.alias("exact_distinct"),
        (F.abs(F.first("n_distinct") - exact) <= F.lit(1) + exact * 0.05).alias("distinct_near"),
        ((below <= count * 0.53 + 1) & (upto >= count * 0.47 - 1)).alias("median_near"))


@query(f"""WITH {EVENTS}, {AHEAD}, {pyramid_sql('ew', 64, 16, _HELD, 'n, held_ms, area_s')},
seen AS (SELECT n, held_ms, area_s FROM nd JOIN (SELECT DISTINCT series AS s FROM ev) ON s = series
  WHERE max_t >= {START} AND min_t < {END} AND max_t - min_t <= {RESOLUTION * 40} AND coalesce(parent_span > {RESOLUTION * 40}, true))
SELECT count(*) AS n_nodes, CAST(sum(n) AS BIGINT) AS n, CAST(sum(held_ms) AS BIGINT) AS held_ms FROM seen""")
def time_weighted_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a range query finds whole, added up."""
    built = stored(spark, events(spark, sf_dir), TIME_WEIGHTED)
    whole = query_lod(built, START, END, RESOLUTION * 40).filter("NOT is_leaf")
    return whole.agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("n").alias("n"), F.sum("held_ms").alias("held_ms"))
