"""Structured Streaming queries, run to the end of their input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.plans.view import view
from tidegrid.registry import EVENTS, events, query, rounded, table
from tidegrid.registry.pyramids import GRID
from tidegrid.registry.views import LOD_SQL, PORT, SHOWN_SQL
from tidegrid.session import new_folder
from tidegrid.sources.tables import as_series, millis
from tidegrid.sources.wide_csv import read_layout
from tidegrid.streaming import append, ingest, runs, windows
from tidegrid.streaming.guard import guard_stream

_END = "~end"  # a marker series far behind the data lets the watermark pass the last group


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return as_series(raw, "event_type", "ts", "value", keep=["event_id"])


def _ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _event_stream(spark, sf_dir).drop("event_id")
    path = new_folder(spark, "end")
    last = events(spark, sf_dir).agg(F.max("t").alias("t"))
    marker = last.select(F.lit(_END).alias("series"), (F.col("t") + 10 * 86_400_000).alias("t"), F.lit(0.0).alias("v"))
    marker.coalesce(1).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(marker.schema).parquet(path))


def _run(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream to its end into a folder and read that."""
    spark, path = stream.sparkSession, new_folder(stream.sparkSession, name)
    (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/_checkpoint")
     .trigger(availableNow=True).start(f"{path}/out").awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _run_batches(stream: DataFrame, path: str, fn: Callable[[DataFrame, int], None]) -> None:
    (stream.writeStream.foreachBatch(fn).option("checkpointLocation", f"{path}/_checkpoint")
     .trigger(availableNow=True).start().awaitTermination())


@query(f"""WITH {EVENTS} SELECT series, t // 3600000 * 3600000 AS t, min(v) AS lo, max(v) AS hi, count(*) AS n,
  round(sum(v), 4) AS total FROM ev GROUP BY 1, 2""")
def stream_tumble(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(windows.stream_tumble(_ended(spark, sf_dir), 3_600_000, 0), "tumble")
    return rounded(out.filter(F.col("series") != _END), "total")


@query(f"""WITH {EVENTS}, f AS (SELECT *, coalesce(t > lag(t) OVER w + 3600000, false) AS starts FROM ev
  WINDOW w AS (PARTITION BY series ORDER BY t)),
s AS (SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY series ORDER BY t) AS id FROM f)
SELECT series, min(t) AS min_t, max(t) AS max_t, min(v) AS lo, max(v) AS hi, count(*) AS n, round(sum(v), 4) AS total
FROM s GROUP BY series, id""")
def stream_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    merge = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    before = spark.conf.get(merge)
    spark.conf.set(merge, "true")
    try:
        out = _run(windows.stream_sections(_ended(spark, sf_dir), 3_600_000, 0), "sections")
    finally:
        spark.conf.set(merge, before)
    return rounded(out.filter(F.col("series") != _END), "total")


@query("""WITH sh AS (SELECT event_type AS series, epoch_us(ts) // 1000 AS t, value AS v, xor(event_id, 63) AS pos,
  event_id * 3 // (SELECT count(*) FROM events) AS part FROM events)
SELECT series, t, v, pos FROM sh QUALIFY coalesce(t > max(t) OVER (PARTITION BY series ORDER BY part, pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)""")
def stream_guard_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard with the last time of each series as keyed state, over batches of one file each."""
    path, raw = new_folder(spark, "keyed"), table(spark, sf_dir, "events")
    n = raw.count()
    for part in range(3):  # files arrive in the order of their names
        raw.filter(F.floor(F.col("event_id") * 3 / F.lit(n)) == part).coalesce(1).write.parquet(f"{path}/in/{part}")
    stream = (spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
              .parquet(f"{path}/in"))
    points = as_series(stream, "event_type", "ts", "value", keep=["event_id"])
    points = points.withColumn("pos", F.col("event_id").bitwiseXOR(F.lit(63))).drop("event_id")
    return _run(guard_stream(points, "pos"), "keyed-guard")


@query("""WITH sh AS (SELECT event_type AS series, epoch_us(ts) // 1000 AS t, value AS v, xor(event_id, 63) AS pos FROM events)
SELECT series, t, v, pos FROM sh QUALIFY coalesce(t > max(t) OVER (PARTITION BY series ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)""")
def stream_drop_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "guard")
    stream = _event_stream(spark, sf_dir).withColumn("pos", F.col("event_id").bitwiseXOR(F.lit(63))).drop("event_id")
    _run_batches(stream, path, ingest.guard_batches(f"{path}/state", ingest.parquet_sink(f"{path}/out"), "pos"))
    return spark.read.parquet(f"{path}/out").drop("batch")


def _appended(spark: SparkSession, sf_dir: str) -> append.Pyramid:
    """Events arriving as several files, one per micro-batch."""
    path = new_folder(spark, "append")
    table(spark, sf_dir, "events").repartition(4, "event_id").write.parquet(f"{path}/in")
    raw = (spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1)
           .parquet(f"{path}/in"))
    points = as_series(raw, "event_type", "ts", "value")
    _run_batches(points, path, append.append_batches(f"{path}/out", "num", 600_000, 16, 4))
    return append.read_appended(spark, f"{path}/out")


@query(f"WITH {EVENTS}, {GRID} SELECT * FROM gd")
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_appended(spark, sf_dir).nodes, "total")


@query(f"""WITH {EVENTS}, {GRID}, nd AS (SELECT * FROM gd), pl AS (SELECT series, t, v, t // 600000 AS node_id FROM ev),
{LOD_SQL}, {SHOWN_SQL} SELECT * FROM se""")
def stream_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view over a pyramid that a stream has appended to."""
    return rounded(view(_appended(spark, sf_dir), PORT), "total")


@query(f"WITH {EVENTS}, {GRID} SELECT * FROM gd")
def stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by runs that are merged while the stream goes on."""
    path = new_folder(spark, "runs")
    table(spark, sf_dir, "events").repartition(6, "event_id").write.parquet(f"{path}/in")
    raw = (spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1)
           .parquet(f"{path}/in"))
    _run_batches(as_series(raw, "event_type", "ts", "value"), path, runs.append_runs(f"{path}/out", "num", 600_000, 16, 4))
    return rounded(runs.read_runs(spark, f"{path}/out").nodes, "total")


@query("""WITH f AS (SELECT *, event_id * 3 // (SELECT count(*) FROM events) AS part, xor(event_id, 63) AS pos,
  CAST(trunc((epoch_us(ts) // 1000) / 1000.0 * 1000) AS BIGINT) AS t FROM events)
SELECT 'value' AS series, t, value AS v FROM f QUALIFY coalesce(t > max(t) OVER (ORDER BY part, pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)""")
def stream_guarded_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files that arrive one after the other, some points out of order, through the loader and the guard."""
    raw = table(spark, sf_dir, "events")
    ms, n = millis(raw, "ts"), raw.count()
    path = new_folder(spark, "guarded-csv")
    for part in range(3):
        own = raw.filter(F.floor(F.col("event_id") * 3 / F.lit(n)) == part)
        (own.orderBy(F.col("event_id").bitwiseXOR(F.lit(63))).coalesce(1)
         .select((ms.cast("decimal(20,3)") / 1000).cast("decimal(20,3)").alias("time"), "value")
         .write.option("header", True).csv(f"{path}/in/part-{part}"))
    layout = read_layout(spark, f"{path}/in/part-0")
    cells = ingest.stream_cells(spark, f"{path}/in/part-*", layout, files_per_batch=1)
    guard = ingest.guard_batches(f"{path}/state", ingest.parquet_sink(f"{path}/out"), "pos")
    _run_batches(cells, path, ingest.melt_batches(layout, {"num": guard}))
    return spark.read.parquet(f"{path}/out").select("series", "t", "v")


@query("SELECT 'value' AS series, CAST(trunc((epoch_us(ts) // 1000) / 1000.0 * 1000) AS BIGINT) AS t, value AS v FROM events")
def stream_wide_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events")
    ms = millis(raw, "ts")
    path = new_folder(spark, "csv-stream")
    raw.select((ms.cast("decimal(20,3)") / 1000).cast("decimal(20,3)").alias("time"), "value",
               F.col("event_type").alias("type")).write.option("header", True).csv(f"{path}/in")
    stream = ingest.stream_wide_csv(spark, f"{path}/in", read_layout(spark, f"{path}/in"))
    return _run(stream.select("series", "t", "v"), "csv-points")
