"""Resampling, sections, nearest lookups and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import aggregates as agg
from tidegrid.operators import nearest, resample as rs, sections as sec
from tidegrid.operators.descent import nearest_points
from tidegrid.operators.intervals import merge_intervals as merged
from tidegrid.operators.scan import split_by
from tidegrid.registry import (EVENTS, LANGUAGES, ROLES, SHIPMENTS, VECTORS, events, languages, query, roles,
                               rounded, shipments, table, vectors)
from tidegrid.registry.pyramids import END, START, stored
from tidegrid.session import materialize
from tidegrid.sources.tables import as_series

HOUR, GAP = 3_600_000, 7_200_000

HOURS = f"""hr AS (SELECT series, count(*) = 1 AS is_leaf, min(t) AS min_t, max(t) AS max_t, min(v) AS lo, max(v) AS hi,
  count(*) AS n, round(sum(v), 4) AS total FROM ev GROUP BY series, t // {HOUR})"""


def sections_sql(source: str, name: str, gap: int, keys: str = "series") -> str:
    """SQL of section_by_gap over ``source`` as CTE ``name``."""
    return f"""{name}_f AS (SELECT *, coalesce(min_t > lag(max_t) OVER (PARTITION BY {keys} ORDER BY min_t) + {gap}, false)
  AS starts FROM {source}),
{name} AS (SELECT * EXCLUDE (starts), CAST(sum(CAST(starts AS INTEGER)) OVER (PARTITION BY {keys} ORDER BY min_t) AS BIGINT)
  AS section_id FROM {name}_f)"""


SECTIONS = sections_sql("hr", "se", GAP)


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rs.resample_points(events(spark, sf_dir), HOUR), "total")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sec.section_by_gap(_hours(spark, sf_dir), GAP)


@query(f"WITH {EVENTS}, {HOURS} SELECT * FROM hr")
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hours(spark, sf_dir)


@query(f"""WITH {EVENTS},
q AS (SELECT series, min(t) AS min_t, max(t) AS max_t, min(v) AS lo, max(v) AS hi, count(*) AS n, sum(v) AS total,
      count(*) = 1 AS is_leaf FROM ev GROUP BY series, t // 900000)
SELECT series, count(*) = 1 AND bool_and(is_leaf) AS is_leaf, min(min_t) AS min_t, max(max_t) AS max_t, min(lo) AS lo,
       max(hi) AS hi, CAST(sum(n) AS BIGINT) AS n, round(sum(total), 4) AS total
FROM q GROUP BY series, min_t // 5400000, max_t // 5400000""")
def resample_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter hours merged into 90 minutes; buckets of both sizes are aligned, so none crosses."""
    quarters = rs.resample_points(events(spark, sf_dir), 900_000)
    return rounded(rs.resample(quarters, 5_400_000), "total")


@query(f"""WITH {VECTORS}
SELECT series, count(*) = 1 AS is_leaf, min(t) AS min_t, max(t) AS max_t, min(list_min(v)) AS lo, max(list_max(v)) AS hi,
       CAST(sum(len(v)) AS BIGINT) AS n, round(sum(list_sum(v)), 6) AS total,
       CASE WHEN count(*) = 1 THEN len(any_value(v)) END AS n_elements
FROM ve GROUP BY series, t // 20""")
def resample_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rounded(rs.resample_points(vectors(spark, sf_dir), 20, "arr"), "total", places=6)
    elements = F.when(F.col("v").isNotNull(), F.size("v").cast("long"))
    return rows.withColumn("n_elements", elements).drop("v")


@query(f"""WITH {LANGUAGES}
SELECT series, count(*) = 1 AS is_leaf, min(t) AS min_t, max(t) AS max_t, count(*) AS n,
       CASE WHEN min(v) = max(v) THEN min(v) END AS summary FROM la GROUP BY series, t // 30""")
def resample_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.resample_points(languages(spark, sf_dir), 30, "str")


@query(f"""WITH {SHIPMENTS}
SELECT series, t // 604800000 * 604800000 AS t, min(v) AS lo, max(v) AS hi, count(*) AS n, round(sum(v), 4) AS total
FROM sh GROUP BY 1, 2""")
def tumble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rs.tumble(shipments(spark, sf_dir), 604_800_000), "total")


@query(f"""WITH {EVENTS}, r AS (SELECT series, min(t) AS start, max(t) AS "end" FROM ev GROUP BY series)
SELECT series, CAST(trunc(("end" - start) / 960.0 * 3.0) AS BIGINT) AS resolution,
       CAST(trunc(16 / (960.0 / ("end" - start))) AS BIGINT) AS tolerance FROM r""")
def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolution and snap tolerance of every series shown whole on 960 pixels."""
    spans = agg.time_extent(events(spark, sf_dir))
    return spans.select("series", rs.min_resolution(F.col("min_t"), F.col("max_t"), 960).alias("resolution"),
                        nearest.snap_tolerance(F.col("min_t"), F.col("max_t"), 960).alias("tolerance"))


@query(f"WITH {EVENTS}, {HOURS}, {SECTIONS} SELECT * FROM se")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir)


@query(f"""WITH {EVENTS}, pt AS (SELECT CAST(user_id AS VARCHAR) AS series, t AS min_t, t AS max_t, event_id FROM ev),
{sections_sql('pt', 'se', 21600000)} SELECT series, min_t, event_id, section_id FROM se""")
def sections_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small series: the raw events of every user cut at gaps of six hours."""
    points = as_series(table(spark, sf_dir, "events"), "user_id", "ts", "value", keep=["event_id"])
    rows = points.select("series", F.col("t").alias("min_t"), F.col("t").alias("max_t"), "event_id")
    return sec.section_by_gap(rows, 21_600_000).drop("max_t")


@query(f"""WITH {EVENTS}, {HOURS}, {SECTIONS}
SELECT series, section_id, min(min_t) AS min_t, max(max_t) AS max_t, count(*) AS n_rows FROM se
GROUP BY series, section_id""")
def section_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sec.section_bounds(_sections(spark, sf_dir))


RUNS = """ru_f AS (SELECT *, coalesce(is_leaf <> lag(is_leaf) OVER w, false) AS starts FROM se
  WINDOW w AS (PARTITION BY series, section_id ORDER BY min_t)),
ru AS (SELECT * EXCLUDE (starts), CAST(sum(CAST(starts AS INTEGER)) OVER (PARTITION BY series, section_id ORDER BY min_t)
  AS BIGINT) AS run_id FROM ru_f)"""


@query(f"WITH {EVENTS}, {HOURS}, {SECTIONS}, {RUNS} SELECT * FROM ru")
def runs_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sec.runs_by_kind(materialize(_sections(spark, sf_dir), "sections"))


@query(f"""WITH {ROLES}, f AS (SELECT *, coalesce(v <> lag(v) OVER (PARTITION BY series ORDER BY t), false) AS starts FROM ro)
SELECT series, t, v, CAST(sum(CAST(starts AS INTEGER)) OVER (PARTITION BY series ORDER BY t) AS BIGINT) AS grp FROM f""")
def split_by_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's split rule: a new group whenever another role speaks."""
    return split_by(roles(spark, sf_dir), ["series"], "t", ["v"], lambda prev, cur: cur["v"] != prev["v"], "grp")


_NEAREST = """pv AS (SELECT p.*, i.min_t AS b_min, i.max_t AS b_max FROM pr p ASOF LEFT JOIN iv i
  ON p.series = i.series AND p.t >= i.min_t),
nx AS (SELECT p.*, i.min_t AS a_min, i.max_t AS a_max FROM pv p ASOF LEFT JOIN iv i
  ON p.series = i.series AND p.t < i.min_t),
dist AS (SELECT *, coalesce(t <= b_max, false) AS inside,
  CASE WHEN t - b_max <= {tol} THEN t - b_max END AS db, CASE WHEN a_min - t <= {tol} THEN a_min - t END AS da FROM nx),
kinds AS (SELECT *, CASE WHEN inside THEN 'contained' WHEN db < da THEN 'before' WHEN da IS NOT NULL THEN 'after'
  WHEN db IS NOT NULL THEN 'before' END AS kind FROM dist),
near AS (SELECT * EXCLUDE (b_min, b_max, a_min, a_max, inside, db, da),
  CASE kind WHEN 'contained' THEN 0 WHEN 'after' THEN da ELSE db END AS distance,
  CASE kind WHEN 'after' THEN a_min ELSE b_min END AS min_t, CASE kind WHEN 'after' THEN a_max ELSE b_max END AS max_t
  FROM kinds WHERE kind IS NOT NULL)"""

_BOUNDS = f"""pt AS (SELECT series, t AS min_t, t AS max_t FROM ev),
{sections_sql('pt', 'ps', 1800000)},
iv AS (SELECT series, min(min_t) AS min_t, max(max_t) AS max_t FROM ps GROUP BY series, section_id)"""


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = events(spark, sf_dir).select("series", F.col("t").alias("min_t"), F.col("t").alias("max_t"))
    return sec.section_bounds(sec.section_by_gap(points, 1_800_000))


@query(f"""WITH {EVENTS}, {_BOUNDS}, pr AS (SELECT 'purchase' AS series, t, event_id FROM ev),
{_NEAREST.format(tol=600000)} SELECT * FROM near""")
def nearest_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event asks for the purchase session it falls in or is next to: one series gets all probes."""
    probes = events(spark, sf_dir, "event_id").select(F.lit("purchase").alias("series"), "t", "event_id")
    return nearest.nearest_interval_join(probes, _bounds(spark, sf_dir), 600_000)


_CURSOR = """WITH {ev}, iv AS (SELECT series, t AS min_t, t AS max_t FROM ev),
pr AS (SELECT series, unnest(range({start}, {end}, {step})) AS t FROM (SELECT DISTINCT series FROM ev)), {near}
SELECT near.series, near.t, kind, distance, min_t, v FROM near JOIN ev ON ev.series = near.series AND ev.t = near.min_t"""


@query(_CURSOR.format(ev=EVENTS, start=START, end=END, step=43_200_001, near=_NEAREST.format(tol=900_000)))
def cursor_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few cursor times in every series, looked up in a stored pyramid node by node."""
    points = events(spark, sf_dir)
    times = spark.range(START, END, 43_200_001).select(F.col("id").alias("t"))
    series = points.select("series").distinct()
    probes = series.withColumn("t", F.explode(F.lit([r["t"] for r in times.collect()]).cast("array<bigint>")))
    return nearest_points(stored(spark, points), probes, 900_000)


_PROBES = "pr AS (SELECT series, t + 1234567 AS t, event_id FROM ev)"


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "event_id").select("series", (F.col("t") + 1_234_567).alias("t"), "event_id")


_AT_NODES = f"""WITH {EVENTS}, {HOURS}, {SECTIONS}, {_PROBES}, iv AS (SELECT series, min_t, max_t FROM se),
{_NEAREST.format(tol=900000)}"""


@query(f"""{_AT_NODES} SELECT near.*, se.section_id, se.is_leaf, se.n, se.total
FROM near JOIN se USING (series, min_t, max_t)""")
def nearest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_value(_probes(spark, sf_dir), _sections(spark, sf_dir), 900_000)


@query(f"""{_AT_NODES} SELECT near.series, t, event_id, se.section_id, se.is_leaf, near.series AS label,
       CASE WHEN se.is_leaf THEN se.total ELSE se.total / se.n END AS value
FROM near JOIN se USING (series, min_t, max_t)""")
def cursor_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readout as numbers; its text is tested apart."""
    return nearest.cursor_readout(_probes(spark, sf_dir), _sections(spark, sf_dir), 900_000).drop("text")


@query(f"""WITH {VECTORS}, pr AS (SELECT series, t + 1 AS t FROM ve),
nd AS (SELECT series, count(*) = 1 AS is_leaf, min(t) AS min_t, max(t) AS max_t, sum(len(v)) AS n,
       sum(list_sum(v)) AS total, any_value(v) AS v FROM ve GROUP BY series, t // 20),
{sections_sql('nd', 'se', 100)}, iv AS (SELECT series, min_t, max_t FROM se), {_NEAREST.format(tol=30)},
hit AS (SELECT near.series, near.t, se.section_id, se.is_leaf,
        CASE WHEN se.is_leaf THEN se.v ELSE [se.total / se.n] END AS vals
        FROM near JOIN se USING (series, min_t, max_t)),
el AS (SELECT *, unnest(range(0, len(vals))) AS i, unnest(vals) AS value FROM hit)
SELECT series, t, section_id, is_leaf, CASE WHEN is_leaf THEN series || CAST(i AS VARCHAR) ELSE series END AS label,
       round(value, 6) AS value FROM el""")
def cursor_readout_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = vectors(spark, sf_dir)
    rows = sec.section_by_gap(rs.resample_points(points, 20, "arr"), 100)
    probes = points.select("series", (F.col("t") + 1).alias("t"))
    return rounded(nearest.cursor_readout(probes, rows, 30, "arr").drop("text"), "value", places=6)


@query(f"""{_AT_NODES}, rd AS (SELECT near.series AS label, t, event_id,
       CASE WHEN se.is_leaf THEN se.total ELSE se.total / se.n END AS value
       FROM near JOIN se USING (series, min_t, max_t))
SELECT * FROM rd ORDER BY value DESC, label""")
def value_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = cursor_readout(spark, sf_dir).select("label", "t", "event_id", "value")
    return nearest.value_order(read)


@query(f"""WITH {EVENTS}, i AS (SELECT series, t AS min_t, t + CAST(v * 20000 AS BIGINT) AS max_t, event_id FROM ev),
f AS (SELECT *, coalesce(min_t >= max(max_t) OVER (PARTITION BY series ORDER BY min_t, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS starts FROM i),
g AS (SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY series ORDER BY min_t, event_id) AS grp FROM f)
SELECT series, min(min_t) AS min_t, max(max_t) AS max_t, count(*) AS n FROM g GROUP BY series, grp""")
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event lasts 20 seconds per unit of its value."""
    points = events(spark, sf_dir)
    lasting = points.select("series", F.col("t").alias("min_t"),
                            (F.col("t") + F.round(F.col("v") * 20_000).cast("long")).alias("max_t"))
    return merged(lasting)
