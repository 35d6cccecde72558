"""Viewport queries and chart-ready tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.aggregates import catalog, time_extent
from tidegrid.operators.sections import runs_by_kind
from tidegrid.plans import chart, view as vw
from tidegrid.registry import EVENTS, VECTORS, events, languages, query, rounded, vectors
from tidegrid.registry.pyramids import LOD, NUM_PYRAMID, stored
from tidegrid.registry.timelines import RUNS, sections_sql
from tidegrid.session import materialize

# 2024-01-05 to 2024-01-25 on 960 pixels, cut at six hours
PORT = vw.Viewport(1704412800000, 1706140800000, 960, 21_600_000)
FRAME = chart.Frame(960, 400, PORT.start, PORT.end, 0.0, 500.0)

_RESAMPLED = """rs AS (SELECT series, count(*) = 1 AND bool_and(is_leaf) AS is_leaf, min(min_t) AS min_t,
  max(max_t) AS max_t, min(lo) AS lo, max(hi) AS hi, CAST(sum(n) AS BIGINT) AS n, round(sum(total), 4) AS total
  FROM lod GROUP BY series, min_t // {res}, max_t // {res})"""
LOD_SQL = LOD.format(start=PORT.start, end=PORT.end, res=PORT.resolution)
SHOWN_SQL = f"""{_RESAMPLED.format(res=PORT.resolution)},
{sections_sql('rs', 'se', PORT.gap_ms)}"""
_VIEW = f"{EVENTS}, {NUM_PYRAMID}, {LOD_SQL}, {SHOWN_SQL}"


def _pyramid(spark: SparkSession, sf_dir: str) -> vw.Pyramid:
    return stored(spark, events(spark, sf_dir))


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vw.view(_pyramid(spark, sf_dir), PORT), "total")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_by_kind(_view(spark, sf_dir), bits=None)  # a view has at most two rows per bucket and series


@query(f"WITH {_VIEW} SELECT * FROM se")
def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir)


@query(f"""WITH {EVENTS}, {NUM_PYRAMID},
rg AS (SELECT series, min(t) AS start, max(t) AS "end", CAST(trunc((max(t) - min(t)) / 320.0 * 3.0) AS BIGINT) AS res
  FROM ev GROUP BY series),
nr AS (SELECT nd.*, res, start, "end" FROM nd JOIN rg USING (series)),
lod AS (SELECT series, res, false AS is_leaf, min_t, max_t, lo, hi, n, total FROM nr
  WHERE max_t >= start AND min_t < "end" AND max_t - min_t <= res AND coalesce(parent_span > res, true)
UNION ALL SELECT pl.series, res, true, t, t, v, v, 1, v FROM pl JOIN nr ON nr.series = pl.series AND nr.level = 0
  AND nr.node_id = pl.node_id WHERE nr.max_t - nr.min_t > res AND nr.max_t >= start AND nr.min_t < "end"
  AND t BETWEEN start AND "end"),
rs AS (SELECT series, count(*) = 1 AND bool_and(is_leaf) AS is_leaf, min(min_t) AS min_t, max(max_t) AS max_t,
  min(lo) AS lo, max(hi) AS hi, CAST(sum(n) AS BIGINT) AS n, round(sum(total), 4) AS total
  FROM lod GROUP BY series, min_t // res, max_t // res),
{sections_sql('rs', 'se', PORT.gap_ms)} SELECT * FROM se""")
def view_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series over its own whole time range, at its own resolution."""
    pyramid = _pyramid(spark, sf_dir)
    ranges = time_extent(pyramid).select("series", F.col("min_t").alias("start"), F.col("max_t").alias("end"))
    return rounded(vw.view_ranges(pyramid, materialize(ranges, "ranges"), 320, PORT.gap_ms), "total")


@query(f"""WITH {_VIEW}, c AS (SELECT series, count(*) AS n_nodes FROM lod GROUP BY series)
SELECT series, n_nodes, count(*) AS n_resampled, max(section_id) + 1 AS n_sections FROM se JOIN c USING (series)
GROUP BY series, n_nodes""")
def view_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.view_metrics(_pyramid(spark, sf_dir), PORT)


@query(f"""WITH {_VIEW}, {RUNS} SELECT series, section_id, run_id, (max_t + min_t) // 2 AS t, lo, hi,
  total / n AS mean FROM ru WHERE NOT is_leaf""")
def band_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart.band_table(_runs(spark, sf_dir))


@query(f"WITH {_VIEW}, {RUNS} SELECT series, section_id, run_id, min_t AS t, total AS v FROM ru WHERE is_leaf")
def line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart.line_table(_runs(spark, sf_dir))


@query(f"""WITH {VECTORS} SELECT series, t, CAST(len(v) AS INTEGER) AS n_lines,
  CAST(unnest(range(0, len(v))) AS INTEGER) AS line, unnest(v) AS v FROM ve""")
def array_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart.array_lines(vectors(spark, sf_dir))


@query(f"""WITH {EVENTS} SELECT series, t, v,
  round((t - {PORT.start}) * (960.0::DOUBLE / {PORT.end - PORT.start}), 6) AS x_px, round((500 - v) * (400.0::DOUBLE / 500), 6) AS y_px
FROM ev""")
def to_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(chart.to_view(events(spark, sf_dir), FRAME), "x_px", "y_px", places=6)


@query(f"""WITH {EVENTS}, la AS (SELECT source AS series, count(*) AS n, min(doc_id) AS min_t, max(doc_id) AS max_t
  FROM documents GROUP BY source), e AS (SELECT series, count(*) AS n, min(t) AS min_t, max(t) AS max_t FROM ev GROUP BY series),
c AS (SELECT series, 'num' AS kind, n, min_t, max_t FROM e UNION ALL SELECT series, 'str', n, min_t, max_t FROM la)
SELECT series, kind, n AS n_submitted, n AS n_points, min_t, max_t, kind = 'num' AS accepted FROM c
WHERE series IN ('view', 'click', 'src0', 'error')""")
def overlay_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = catalog(events(spark, sf_dir).withColumn("kept", F.lit(True)), "num")
    texts = catalog(languages(spark, sf_dir).withColumn("kept", F.lit(True)), "str")
    return chart.overlay(numbers.unionByName(texts), ["view", "click", "src0", "error"], strict=False)
