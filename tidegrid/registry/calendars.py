"""Calendar scales, spines, labels and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import calendar as cal
from tidegrid.operators.aggregates import time_extent
from tidegrid.plans.chart import axis_scales as chart_scales
from tidegrid.registry import EVENTS, SHIPMENTS, events, query, rounded, shipments

_UNITS = {"year_1": "year", "month": "month", "day": "day", "hour": "hour", "minute": "minute", "second": "second"}
_SPANS = """sp AS (SELECT series, min(t) AS start, max(t) AS "end" FROM {} GROUP BY series)"""


def _spans(points: DataFrame) -> DataFrame:
    return time_extent(points).select("series", F.col("min_t").alias("start"), F.col("max_t").alias("end"))


@query(f"""WITH {EVENTS} SELECT series, t, {', '.join(
    f"epoch_ms(date_trunc('{unit}', make_timestamp_ms(t))) AS {name}" for name, unit in _UNITS.items())},
  epoch_ms(make_timestamp(year(make_timestamp_ms(t)) // 10 * 10, 1, 1, 0, 0, 0)) AS year_10,
  t // 21600000 * 21600000 AS hour_6, t // 600000 * 600000 AS minute_10, t // 100 * 100 AS ms_100 FROM ev""")
def calendar_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*_UNITS, "year_10", "hour_6", "minute_10", "ms_100"]
    return events(spark, sf_dir).select("series", "t", *[
        cal.calendar_trunc(F.col("t"), name).alias(name) for name in names])


@query(f"""WITH {EVENTS} SELECT series, t, epoch_ms(make_timestamp_ms(t) + INTERVAL 2 YEAR) AS year_1,
  epoch_ms(make_timestamp_ms(t) + INTERVAL 2 MONTH) AS month, t + 2 * 86400000 AS day, t + 2 * 21600000 AS hour_6,
  t + 2 * 10 AS ms_10 FROM ev""")
def calendar_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("series", "t", *[
        cal.calendar_advance(F.col("t"), name, 2).alias(name) for name in ("year_1", "month", "day", "hour_6", "ms_10")])


@query(f"WITH {EVENTS}, tk AS (SELECT series, start, \"end\", unnest(generate_series("
       "start // 21600000 * 21600000, \"end\", 21600000)) AS tick FROM "
       "(SELECT series, min(t) AS start, max(t) AS \"end\" FROM ev GROUP BY series)) "
       "SELECT * FROM tk WHERE tick > start AND tick < \"end\"")
def tick_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.tick_spine(_spans(events(spark, sf_dir)), "hour_6")


@query(f"""WITH {SHIPMENTS}, {_SPANS.format('sh')},
tk AS (SELECT series, start, "end", unnest(generate_series(date_trunc('month', make_timestamp_ms(start)),
  make_timestamp_ms("end"), INTERVAL 1 MONTH)) AS m FROM sp)
SELECT series, start, "end", epoch_ms(m) AS tick FROM tk
WHERE epoch_ms(m) < "end" AND m > date_trunc('month', make_timestamp_ms(start))""")
def tick_spine_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.tick_spine(_spans(shipments(spark, sf_dir)), "month")


@query(f"""WITH {EVENTS}, b AS (SELECT series, t // 3600000 * 3600000 AS t, min(v) AS lo, max(v) AS hi, count(*) AS n,
  round(sum(v), 4) AS total FROM ev GROUP BY 1, 2),
s AS (SELECT series, unnest(generate_series(min(t), max(t), 3600000)) AS t FROM b GROUP BY series)
SELECT series, t, lo, hi, coalesce(n, 0) AS n, total FROM s LEFT JOIN b USING (series, t)""")
def calendar_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cal.calendar_rollup(events(spark, sf_dir), "hour"), "total")


QUARTER = cal.CalendarScale("quarter", "month", 3, "MMM")


@query(f"""WITH {SHIPMENTS}, b AS (SELECT series, date_trunc('quarter', make_timestamp_ms(t)) AS q, min(v) AS lo,
  max(v) AS hi, count(*) AS n, round(sum(v), 4) AS total FROM sh GROUP BY 1, 2),
s AS (SELECT series, unnest(generate_series(min(q), max(q), INTERVAL 3 MONTH)) AS q FROM b GROUP BY series)
SELECT series, epoch_ms(q) AS t, lo, hi, coalesce(n, 0) AS n, total FROM s LEFT JOIN b USING (series, q)""")
def calendar_rollup_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-defined scale of three months."""
    return rounded(cal.calendar_rollup(shipments(spark, sf_dir), QUARTER), "total")


@query(f"""WITH {EVENTS}, x AS (SELECT series, t, make_timestamp_ms(t) AS ts FROM ev) SELECT series, t,
  strftime(ts, '%Y %b ') || day(ts) || strftime(ts, ' (%a) [UTC / Z]') AS day_full,
  day(ts) || strftime(ts, ' d (%a)') AS day_short,
  strftime(ts, '%Y %b ') || day(ts) || strftime(ts, ' (%a)  %H:%M:%S [UTC / Z]') AS second_full,
  strftime(ts, '%H h') AS hour_short, strftime(ts, '%g ms') AS ms_short, strftime(ts, '%Y y') AS year_short FROM x""")
def tick_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return events(spark, sf_dir).select(
        "series", "t", cal.tick_label(t, "day", full=True).alias("day_full"), cal.tick_label(t, "day").alias("day_short"),
        cal.tick_label(t, "second", full=True).alias("second_full"), cal.tick_label(t, "hour_6").alias("hour_short"),
        cal.tick_label(t, "ms_10").alias("ms_short"), cal.tick_label(t, "year_1").alias("year_short"))


_SCALES = "sc AS (SELECT * FROM (VALUES {}) AS s(place, name, ms, context))".format(", ".join(
    f"({i}, '{s.name}', {s.nominal_ms}, {str(s.prefix is not None).lower()})" for i, s in enumerate(cal.SCALES)))


@query(f"""WITH {EVENTS}, {_SCALES},
g AS (SELECT series, t, t - lag(t) OVER (PARTITION BY series ORDER BY t) AS span FROM ev QUALIFY span IS NOT NULL),
b AS (SELECT series, t, span, coalesce(max(place) FILTER (ms > span), 0) AS place FROM g CROSS JOIN sc GROUP BY ALL)
SELECT b.series, b.t, b.span, sc.name AS scale FROM b JOIN sc USING (place)""")
def best_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale for the gap before every event."""
    from tidegrid.operators.scan import last_before, ordered_scan
    gaps = ordered_scan(events(spark, sf_dir), ["series"], "t", {"before": last_before(F.col("t"))})
    gaps = gaps.select("series", "t", (F.col("t") - F.col("before")).alias("span")).filter("span is not null")
    return gaps.withColumn("scale", cal.best_scale(F.col("span")))


@query(f"""WITH {EVENTS}, {_SCALES}, u AS (SELECT CAST(user_id AS VARCHAR) AS series, t FROM ev), {_SPANS.format('u')},
b AS (SELECT sp.*, coalesce(max(place) FILTER (ms > CAST(trunc(64 / (960.0 / ("end" - start))) AS BIGINT)), 0) AS place
  FROM sp CROSS JOIN sc GROUP BY ALL),
n AS (SELECT place, name, coalesce((SELECT max(c.place) FROM sc c WHERE c.place < s.place AND c.context), 0) AS cp,
  coalesce((SELECT min(f.place) FROM sc f WHERE f.place > s.place AND f.context), 14) AS fp FROM sc s)
SELECT series, start, "end", n.name AS tick_scale, c.name AS context_scale, f.name AS finer_scale
FROM b JOIN n USING (place) JOIN sc c ON c.place = cp JOIN sc f ON f.place = fp""")
def axis_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick, context and cursor scale of every user's time span."""
    from tidegrid.registry import table
    from tidegrid.sources.tables import as_series
    users = as_series(table(spark, sf_dir, "events"), "user_id", "ts", "value")
    return chart_scales(_spans(users), 960)


@query(f"""WITH {EVENTS}, {_SPANS.format('ev')}, tk AS (SELECT series, start, "end",
  unnest(generate_series(start // 86400000 * 86400000, "end", 86400000)) AS tick FROM sp)
SELECT *, (greatest(tick, start) + least(tick + 86400000, "end")) // 2 AS mid FROM tk WHERE tick < "end" """)
def label_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.label_midpoints(_spans(events(spark, sf_dir)), "day")


@query(f"WITH {EVENTS} SELECT series, t, make_timestamp_ms(t) - INTERVAL 6 HOUR AS wall, t AS back FROM ev")
def zoned_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch ms to Chicago wall clock (in January) and back."""
    wall = cal.to_zoned(F.col("t"), "America/Chicago")
    return events(spark, sf_dir).select("series", "t", wall.alias("wall")).withColumn(
        "back", cal.from_zoned(F.col("wall"), "America/Chicago"))
