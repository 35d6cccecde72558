"""Points, aggregates and ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.model import AggregateSpec
from tidegrid.operators import aggregates as agg
from tidegrid.operators import points as pts
from tidegrid.operators.resample import resample_points
from tidegrid.registry import (EVENTS, LANGUAGES, ROLES, SHIPMENTS, VECTORS, events, languages, query, roles,
                               rounded, shipments, table, vectors)
from tidegrid.session import new_folder
from tidegrid.sources import wide_csv
from tidegrid.sources.readers import ColumnReader, read_columns
from tidegrid.sources.store import read_points, write_points
from tidegrid.sources.tables import as_series, millis

# 2024-01-10 to 2024-01-20
START, END = 1704844800000, 1705708800000


@query(f"""WITH {SHIPMENTS}
SELECT series, min(t) AS min_t, max(t) AS max_t, min(v) AS lo, max(v) AS hi, count(*) AS n,
       round(sum(v), 4) AS total, round(sum(v) / count(*), 6) AS mean
FROM sh GROUP BY series""")
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(agg.series_summary(shipments(spark, sf_dir), "num"), "total"), "mean", places=6)


@query(f"""WITH {SHIPMENTS}
SELECT series, t, min(v) AS lo, max(v) AS hi, count(*) AS n, round(sum(v), 4) AS total FROM sh GROUP BY series, t""")
def unique_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pts.unique_times(shipments(spark, sf_dir)), "total")


def _shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arriving in an order that goes back in time: blocks of 64 ids reversed."""
    points = events(spark, sf_dir, "event_id")
    return points.withColumn("pos", F.col("event_id").bitwiseXOR(F.lit(63))).drop("event_id")


_SHUFFLED = """sh AS (SELECT event_type AS series, epoch_us(ts) // 1000 AS t, value AS v, xor(event_id, 63) AS pos FROM events),
mk AS (SELECT *, coalesce(t > max(t) OVER (PARTITION BY series ORDER BY pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS kept FROM sh)"""


@query(f"WITH {_SHUFFLED} SELECT series, t, v, pos FROM mk WHERE kept")
def drop_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts.drop_backward(_shuffled(spark, sf_dir), "pos")


@query(f"""WITH {_SHUFFLED}
SELECT series, 'num' AS kind, count(*) AS n_submitted, count(*) FILTER (kept) AS n_points,
       min(t) FILTER (kept) AS min_t, max(t) FILTER (kept) AS max_t FROM mk GROUP BY series""")
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.catalog(pts.mark_backward(_shuffled(spark, sf_dir), "pos"), "num")


@query(f"WITH {EVENTS} SELECT series, t, v, event_id AS pos FROM ev")
def require_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = events(spark, sf_dir, "event_id").withColumnRenamed("event_id", "pos")
    return pts.require_ordered(points, "pos")


@query(f"WITH {SHIPMENTS} SELECT min(v) AS lo, max(v) AS hi FROM sh")
def value_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.value_limits(shipments(spark, sf_dir))


@query(f"WITH {SHIPMENTS} SELECT series, min(t) AS min_t, max(t) AS max_t FROM sh GROUP BY series")
def time_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.time_extent(shipments(spark, sf_dir))


@query(f"""WITH {EVENTS}
SELECT series, min(t) AS first_t, arg_min(v, t) AS first_v, max(t) AS last_t, arg_max(v, t) AS last_v
FROM ev GROUP BY series""")
def first_last_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts.first_last_point(events(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT series, t, v FROM ev WHERE t BETWEEN {START} AND {END}")
def range_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_series(table(spark, sf_dir, "events"), "event_type", "ts", "value", between=(START, END))


@query(f"WITH {EVENTS} SELECT series, t, v FROM ev WHERE t BETWEEN {START} AND {END}")
def stored_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "points")
    write_points(events(spark, sf_dir), path)
    return pts.range_points(read_points(spark, path), START, END)


@query(f"WITH {EVENTS} SELECT series, t, v FROM ev ORDER BY series, t")
def scan_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts.scan_points(events(spark, sf_dir))


@query(f"""WITH {EVENTS}
SELECT series, t, v, CASE WHEN row_number() OVER (PARTITION BY series ORDER BY t) <= 100 THEN 'first' ELSE 'rest' END
  AS part FROM ev""")
def split_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, rest = pts.split_at(events(spark, sf_dir), 100)
    return pts.concat_points(first.withColumn("part", F.lit("first")), rest.withColumn("part", F.lit("rest")))


@query(f"WITH {EVENTS} SELECT series, t, v FROM ev QUALIFY row_number() OVER (PARTITION BY series ORDER BY t) > 1")
def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts.tail(events(spark, sf_dir))


@query(f"""WITH {EVENTS}
SELECT series, t, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS pos,
       count(*) OVER (PARTITION BY series) AS series_n, v FROM ev""")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts.with_positions(events(spark, sf_dir))


@query("""SELECT event_type AS series, epoch_us(ts) // 1000 AS t, value AS v FROM events
UNION ALL SELECT o_orderpriority, epoch_us(o_orderdate) // 1000, o_totalprice FROM orders""")
def concat_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = as_series(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice")
    return pts.concat_points(events(spark, sf_dir), orders)


@query(f"WITH {EVENTS} SELECT series, t, round(v * 2 + t % 1000, 4) AS v FROM ev WHERE v > 20")
def filter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = pts.filter_points(events(spark, sf_dir), F.col("v") > 20)
    return pts.map_points(kept, lambda t, v: F.round(v * 2 + t % 1000, 4))


@query(f"WITH {LANGUAGES} SELECT DISTINCT series, v FROM la")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.distinct_values(languages(spark, sf_dir))


@query(f"""WITH {VECTORS}
SELECT series, min(list_min(v)) AS lo, max(list_max(v)) AS hi, CAST(sum(len(v)) AS BIGINT) AS n,
       round(sum(list_sum(v)), 6) AS total FROM ve GROUP BY series""")
def agg_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agg.agg_points(vectors(spark, sf_dir), "arr"), "total", places=6)


@query(f"""WITH {ROLES}
SELECT series, count(*) AS n, CASE WHEN min(v) = max(v) THEN min(v) END AS summary FROM ro GROUP BY series""")
def agg_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.agg_points(roles(spark, sf_dir), "str")


@query(f"""WITH {EVENTS}
SELECT series, min(t) AS min_t, max(t) AS max_t, min(v) AS lo, max(v) AS hi, count(*) AS n,
       round(sum(v), 4) AS total FROM ev GROUP BY series""")
def merge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = resample_points(events(spark, sf_dir), 3_600_000)
    return rounded(agg.agg_nodes(hours, "num"), "total")


@query(f"""WITH {VECTORS}, nodes AS (SELECT series, t // 50 AS b, min(t) AS min_t, max(t) AS max_t,
  min(list_min(v)) AS lo, max(list_max(v)) AS hi, sum(len(v)) AS n, sum(list_sum(v)) AS total FROM ve GROUP BY 1, 2)
SELECT series, min(min_t) AS min_t, max(max_t) AS max_t, min(lo) AS lo, max(hi) AS hi, CAST(sum(n) AS BIGINT) AS n,
       round(sum(total), 6) AS total FROM nodes GROUP BY series""")
def merge_nodes_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agg.agg_nodes(resample_points(vectors(spark, sf_dir), 50, "arr"), "arr"), "total", places=6)


@query(f"""WITH {LANGUAGES}, nodes AS (SELECT series, t // 25 AS b, min(t) AS min_t, max(t) AS max_t, count(*) AS n,
  CASE WHEN min(v) = max(v) THEN min(v) END AS summary FROM la GROUP BY 1, 2)
SELECT series, min(min_t) AS min_t, max(max_t) AS max_t, CAST(sum(n) AS BIGINT) AS n,
       CASE WHEN min(summary) = max(summary) AND count(summary) = count(*) THEN min(summary) END AS summary
FROM nodes GROUP BY series""")
def merge_nodes_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.agg_nodes(resample_points(languages(spark, sf_dir), 25, "str"), "str")


# a user-defined aggregate: count, sum and sum of squares, read as mean and variance
MOMENTS = AggregateSpec(
    kind="moments",
    lift=lambda v: {"n": F.lit(1).cast("long"), "s1": v, "s2": v * v},
    merge={"n": F.sum, "s1": F.sum, "s2": F.sum},
    finals={"mean": lambda c: c("s1") / c("n"),
            "variance": lambda c: c("s2") / c("n") - (c("s1") / c("n")) * (c("s1") / c("n"))})


@query(f"""WITH {SHIPMENTS}
SELECT series, min(t) AS min_t, max(t) AS max_t, count(*) AS n, round(sum(v), 3) AS s1, round(sum(v * v), 3) AS s2,
       round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance FROM sh GROUP BY series""")
def user_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = agg.series_summary(shipments(spark, sf_dir), MOMENTS)
    return rounded(rounded(summary, "s1", "s2", places=3), "mean", "variance", places=6)


def _written_csv(df: DataFrame, name: str) -> str:
    path = f"{new_folder(df.sparkSession, name)}/{name}.csv"
    df.write.option("header", True).csv(path)
    return path


def events_csv(spark: SparkSession, sf_dir: str) -> str:
    raw = table(spark, sf_dir, "events")
    ms = millis(raw, "ts")
    return _written_csv(raw.select((ms.cast("decimal(20,3)") / 1000).cast("decimal(20,3)").alias("time"),
                                   "value", F.col("event_type").alias("type"), F.col("user_id").alias("user"),
                                   F.lit(None).cast("string").alias("unused")), "events-csv")


@query("""SELECT CAST(trunc((epoch_us(ts) // 1000) / 1000.0 * 1000) AS BIGINT) AS t, 'value' AS series, value AS v FROM events
UNION ALL SELECT CAST(trunc((epoch_us(ts) // 1000) / 1000.0 * 1000) AS BIGINT), 'user', CAST(user_id AS DOUBLE) FROM events""")
def melt_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = events_csv(spark, sf_dir)
    layout = wide_csv.read_layout(spark, path)
    return wide_csv.melt_numeric(wide_csv.read_wide_csv(spark, path, layout.header), layout).drop("file", "pos")


@query("""SELECT CAST(trunc((epoch_us(ts) // 1000) / 1000.0 * 1000) AS BIGINT) AS t, 'type' AS series, event_type AS v
FROM events""")
def melt_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = events_csv(spark, sf_dir)
    layout = wide_csv.read_layout(spark, path)
    return wide_csv.melt_string(wide_csv.read_wide_csv(spark, path, layout.header), layout).drop("file", "pos")


@query("""SELECT 'e' AS series, vec_id * 1000 AS t, unnest(range(0, len(embedding)))::INTEGER AS line,
       unnest(embedding::DOUBLE[]) AS v FROM embeddings""")
def zip_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "embeddings")
    width = raw.agg(F.max(F.size("embedding"))).first()[0]
    path = _written_csv(raw.select(F.col("vec_id").alias("time"), *[
        F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(width)]), "vectors-csv")
    layout = wide_csv.read_layout(spark, path)
    arrays = wide_csv.zip_arrays(wide_csv.read_wide_csv(spark, path, layout.header), layout)
    return arrays.select("series", "t", F.posexplode("v").alias("line", "v"))


@query("""WITH k AS (SELECT *, coalesce(t > max(t) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)
  AS kept FROM (SELECT *, xor(event_id, 15) AS pos, CAST(trunc((epoch_us(ts) // 1000) / 1000.0 * 1000) AS BIGINT) AS t FROM events))
SELECT 'value' AS series, t, value AS v FROM k WHERE kept
UNION ALL SELECT 'user', t, CAST(user_id AS DOUBLE) FROM k WHERE kept""")
def load_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of part files, some points out of order; the parts follow each other by name."""
    raw = table(spark, sf_dir, "events").withColumn("pos", F.col("event_id").bitwiseXOR(F.lit(15)))
    ms = millis(raw, "ts")
    path = f"{new_folder(spark, 'parts')}/events.csv"
    (raw.repartitionByRange(4, "pos").sortWithinPartitions("pos")
     .select((ms.cast("decimal(20,3)") / 1000).cast("decimal(20,3)").alias("time"), "value",
             F.col("event_type").alias("type"), F.col("user_id").alias("user")).write.option("header", True).csv(path))
    return wide_csv.load_all(spark, [path]).points("num")


@query("""SELECT unnest(['value', 'type', 'user', 'unused']) AS name,
       unnest(['num', 'str', 'num', NULL]) AS kind""")
def infer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of all columns of the events file, from every row instead of the first ones."""
    layout = wide_csv.read_layout(spark, events_csv(spark, sf_dir), sample_rows=None)
    return spark.createDataFrame(list(zip(layout.header[1:], layout.kinds)), "name STRING, kind STRING")


def change(state: tuple, t: int, cells: tuple) -> tuple[tuple, tuple | None]:
    """The difference of two columns, and how much it has changed since the row before that had both."""
    if None in cells:
        return state, None
    now = float(cells[0]) - float(cells[1])
    return (now,), None if state[0] is None else (t, now - state[0])


CHANGE = ColumnReader("change", ["value", "user_id"], "DOUBLE", "before DOUBLE", (None,), change)


@query("""WITH d AS (SELECT event_id, CAST(trunc((epoch_us(ts) // 1000) / 1000.0 * 1000) AS BIGINT) AS t, value - user_id AS now
  FROM events),
c AS (SELECT t, now - lag(now) OVER (ORDER BY event_id) AS v FROM d)
SELECT 'change' AS series, t, round(v, 6) AS v FROM c WHERE v IS NOT NULL""")
def read_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's reader of two columns that remembers the row before."""
    raw, path = table(spark, sf_dir, "events"), new_folder(spark, "changes")
    (raw.orderBy("event_id").coalesce(1).select((millis(raw, "ts").cast("decimal(20,3)") / 1000).cast("decimal(20,3)").alias("time"),
                                                "value", "user_id").write.option("header", True).csv(path))
    header = ["time", "value", "user_id"]
    return rounded(read_columns(wide_csv.read_wide_csv(spark, path, header), header, CHANGE).select("series", "t", "v"), "v", places=6)
