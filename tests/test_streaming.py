import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidegrid.operators import points as pts, pyramid as pyr
from tidegrid.operators.sections import section_bounds, section_by_gap
from tidegrid.sources import wide_csv as wc
from tidegrid.streaming import append, ingest, windows

SCHEMA = "series STRING, t BIGINT, v DOUBLE, pos BIGINT"
BATCHES = [[("a", 1, 1.0, 0), ("b", 5, 1.0, 1), ("a", 3, 2.0, 2)],
           [("a", 2, 3.0, 3), ("a", 9, 4.0, 4), ("b", 5, 2.0, 5), ("a", 8, 9.0, 6)],
           [("b", 6, 3.0, 7), ("c", 0, 1.0, 8), ("a", 9, 5.0, 9), ("a", 10, 6.0, 10)]]


@pytest.fixture
def streamed(spark, tmp_path):
    """A stream taking one batch per micro-batch."""
    for i, batch in enumerate(BATCHES):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    def read(last=len(BATCHES)):
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(
            f"{tmp_path}/in/[0-{last - 1}]")
    return read


def run(stream, path, fn):
    stream.writeStream.foreachBatch(fn).option("checkpointLocation", f"{path}/cp").trigger(
        availableNow=True).start().awaitTermination()


def whole(spark):
    return spark.createDataFrame([r for b in BATCHES for r in b], SCHEMA)


def test_guard_carries_over_batches(spark, tmp_path, streamed, rows):
    run(streamed(), tmp_path, ingest.guard_batches(f"{tmp_path}/state", ingest.parquet_sink(f"{tmp_path}/out"), "pos"))
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert rows(got) == rows(pts.drop_backward(whole(spark), "pos"))


def test_repeated_batch_gives_the_same(spark, tmp_path, rows):
    guard = ingest.guard_batches(f"{tmp_path}/state", ingest.parquet_sink(f"{tmp_path}/out"), "pos", bits=1)
    for i in (0, 0, 1, 1, 2, 2):
        guard(spark.createDataFrame(BATCHES[i], SCHEMA), i)
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert rows(got) == rows(pts.drop_backward(whole(spark), "pos"))


def test_append_equals_batch(spark, tmp_path, streamed, rows):
    fn = append.append_batches(f"{tmp_path}/out", "num", 2, 4, 3)
    run(streamed(), tmp_path, fn)
    want = pyr.build_time_pyramid(whole(spark).drop("pos"), "num", 2, 4, 3).nodes
    got = append.read_appended(spark, f"{tmp_path}/out").nodes
    assert rows(got, *want.columns) == rows(want)
    fn(spark.createDataFrame(BATCHES[1], SCHEMA), 1)  # the batch comes again
    assert rows(append.read_appended(spark, f"{tmp_path}/out").nodes, *want.columns) == rows(want)
    append.compact(spark, f"{tmp_path}/out", f"{tmp_path}/base", upto=1)
    got = append.read_appended(spark, f"{tmp_path}/out", base=f"{tmp_path}/base", after=1).nodes
    assert rows(got, *want.columns) == rows(want)


def ended(spark, tmp_path, pairs):
    """A stream of points whose last row is far behind the others."""
    data = [("s", t, float(v)) for t, v in pairs] + [("~end", 10_000_000, 0.0)]
    spark.createDataFrame(data, "series STRING, t BIGINT, v DOUBLE").coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema("series STRING, t BIGINT, v DOUBLE").parquet(f"{tmp_path}/in")


def written(spark, tmp_path, stream):
    (stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
     .start(f"{tmp_path}/out").awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").filter("series <> '~end'")


def test_tumble(spark, tmp_path, rows):
    got = written(spark, tmp_path, windows.stream_tumble(ended(spark, tmp_path, [(0, 1), (9, 3), (10, 5)]), 10, 0))
    assert rows(got) == [("s", 0, 1.0, 3.0, 2, 4.0), ("s", 10, 5.0, 5.0, 1, 5.0)]


def test_sections_equal_batch(spark, tmp_path, points, rows):
    pairs = [(0, 1), (5500, 2), (11_001, 3), (11_002, 4), (20_000, 5)]  # the first two are exactly one gap apart
    got = written(spark, tmp_path, windows.stream_sections(ended(spark, tmp_path, pairs), 5500, 0))
    spans = points(pairs).select("series", F.col("t").alias("min_t"), F.col("t").alias("max_t"))
    assert rows(got, "min_t", "max_t", "n") == rows(section_bounds(section_by_gap(spans, 5500)), "min_t", "max_t", "n_rows")


def test_wide_csv(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("time,x,s\n1,5,on\n2,,off\n")
    (tmp_path / "in" / "b.csv").write_text("time,x,s\n3,7,on\n")
    layout = wc.read_layout(spark, str(tmp_path / "in" / "a.csv"))
    number = ingest.stream_wide_csv(spark, str(tmp_path / "in"), layout)
    assert rows(written(spark, tmp_path, number.drop("file"))) == [("x", 1000, 5.0), ("x", 3000, 7.0)]
    text = ingest.stream_wide_csv(spark, str(tmp_path / "in"), layout, "str")
    assert text.isStreaming and text.columns == ["series", "t", "v", "file"]


def test_wide_csv_with_another_header_fails(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("time,x,y\n1,5,6\n")
    layout = wc.read_layout(spark, str(tmp_path / "in" / "a.csv"))
    (tmp_path / "in" / "b.csv").write_text("time,y,x\n3,7,8\n")
    with pytest.raises(StreamingQueryException):
        written(spark, tmp_path, ingest.stream_wide_csv(spark, str(tmp_path / "in"), layout).drop("file"))


def test_files_through_the_guard(spark, tmp_path, rows):
    """Numbers and arrays of several files in several batches; a later file may go back in time."""
    (tmp_path / "in").mkdir()
    texts = ["time,x,a0,a1,a2,a3\n1,5,1,2,3,4\n4,6,1,2,3,5\n", "time,x,a0,a1,a2,a3\n3,7,,,,\n9,8,4,3,2,1\n",
             "time,x,a0,a1,a2,a3\n9,1,,,,\n10,2,,,,\n"]
    for i, text in enumerate(texts):
        (tmp_path / "in" / f"{i}.csv").write_text(text)
        os.utime(tmp_path / "in" / f"{i}.csv", (1000 + i, 1000 + i))
    layout = wc.read_layout(spark, str(tmp_path / "in" / "0.csv"))
    guard = ingest.guard_batches(f"{tmp_path}/state", ingest.parquet_sink(f"{tmp_path}/num"), "pos")
    melt = ingest.melt_batches(layout, {"num": guard, "arr": ingest.parquet_sink(f"{tmp_path}/arr")})
    run(ingest.stream_cells(spark, str(tmp_path / "in"), layout, files_per_batch=1), tmp_path, melt)
    assert rows(spark.read.parquet(f"{tmp_path}/num"), "t", "v") == [(1000, 5.0), (4000, 6.0), (9000, 8.0), (10000, 2.0)]
    assert rows(spark.read.parquet(f"{tmp_path}/arr"), "t") == [(1000,), (4000,), (9000,)]


def test_lost_state_fails(spark, tmp_path):
    guard = ingest.guard_batches(f"{tmp_path}/state", ingest.parquet_sink(f"{tmp_path}/out"), "pos")
    with pytest.raises(ValueError, match="state of batch 0"):
        guard(spark.createDataFrame(BATCHES[1], SCHEMA), 1)
    for i in (0, 1):
        guard(spark.createDataFrame(BATCHES[i], SCHEMA), i)
    with pytest.raises(ValueError, match="new folder"):
        guard(spark.createDataFrame(BATCHES[0], SCHEMA), 0)
