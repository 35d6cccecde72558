import pytest
from pyspark.sql import functions as F

from tidegrid.model import lift_points
from tidegrid.operators import aggregates as agg
from tidegrid.operators import pyramid as pyr
from tidegrid.operators.lod import query_lod
from tidegrid.operators.resample import resample
from tidegrid.operators.sections import runs_by_kind, section_by_gap
from tidegrid.plans import chart, view as vw
from tidegrid.session import new_folder
from tidegrid.sources.store import read_pyramid, write_pyramid

PORT = vw.Viewport(1_000, 31_000, 300, 2_000)


@pytest.fixture(scope="module")
def pyramid(spark):
    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("series"),
                                     (F.col("id") * 10 + F.when(F.col("id") > 1500, 5000).otherwise(0)).alias("t"),
                                     (F.col("id") % 17).cast("double").alias("v"))
    path = new_folder(spark, "view")
    write_pyramid(pyr.build_pyramid(df, "num", 8, 4), path)
    return read_pyramid(spark, path)


def test_view_chains_the_stages(pyramid, rows):
    assert PORT.resolution == 300
    got = vw.view(pyramid, PORT)
    plain = section_by_gap(resample(query_lod(pyramid, 1_000, 31_000, 300), 300), 2_000, bits=6)
    assert rows(got, *plain.columns) == rows(plain)
    assert rows(got.groupBy("series").agg(F.max("section_id"))) == [("a", 1), ("b", 1)]
    wide = vw.view(pyramid, vw.Viewport(1_000, 31_000, vw.WIDEST_PX * 2, 2_000))
    assert wide.count() == pyramid.points.filter("t between 1000 and 31000").count()


def test_ranges_per_series(spark, pyramid, rows):
    ranges = spark.createDataFrame([("a", 1_000, 31_000), ("b", 0, 9_000)], "series STRING, start BIGINT, end BIGINT")
    got = vw.view_ranges(pyramid, ranges, 300, 2_000)
    both = vw.view(vw.choose(pyramid, ["a"]), PORT).unionByName(
        vw.view(vw.choose(pyramid, ["b"]), vw.Viewport(0, 9_000, 300, 2_000)))
    assert rows(got, *both.columns) == rows(both)


def test_range_filter_reaches_the_files(pyramid):
    plan = query_lod(pyramid, 1_000, 2_000, 100)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(max_t,1000)" in plan and "LessThan(min_t,2000)" in plan
    assert "GreaterThanOrEqual(t,1000)" in plan and "level#" in plan.split("PartitionFilters: [")[2]


def test_metrics_and_stages(pyramid, rows):
    counts = rows(vw.view_metrics(pyramid, PORT), "series", "n_nodes", "n_resampled", "n_sections")
    shown, stages = vw.timed_view(pyramid, PORT)
    assert [s.name for s in stages] == ["range", "resample", "section"]
    assert [s.rows for s in stages[:2]] == [sum(c[1] for c in counts), sum(c[2] for c in counts)]
    assert stages[2].rows == stages[1].rows == shown.count() and all(s.seconds > 0 for s in stages)


def test_cache(pyramid):
    cache = vw.ViewCache(pyramid)
    first = cache.get(PORT)
    assert first.storageLevel.useMemory and cache.get(PORT) is first
    other = cache.get(vw.Viewport(0, 9_000, 300))
    assert other is not first and not first.storageLevel.useMemory
    chosen = cache.get(vw.Viewport(0, 9_000, 300), ["a"])
    assert chosen is not other and {r["series"] for r in chosen.select("series").distinct().collect()} == {"a"}
    assert cache.get(vw.Viewport(0, 9_000, 300), ["a"]) is chosen
    cache.clear()
    assert not chosen.storageLevel.useMemory
    assert not other.storageLevel.useMemory


def test_chart_tables(spark, points, rows):
    df = points([(0, 1), (7, 2), (11, 4), (12, 6), (25, 3)])
    sectioned = section_by_gap(resample(lift_points(df, "num"), 5), 10)
    runs = runs_by_kind(sectioned)
    assert rows(chart.band_table(runs), "section_id", "run_id", "t", "lo", "hi", "mean") == [(0, 1, 11, 4.0, 6.0, 5.0)]
    assert rows(chart.line_table(runs), "section_id", "run_id", "t", "v") == [(0, 0, 0, 1.0), (0, 0, 7, 2.0), (1, 0, 25, 3.0)]


def test_pixels(spark, rows):
    frame = chart.Frame(100, 50, 1_000, 2_000, -1.0, 1.0)
    df = spark.createDataFrame([(1_000, 1.0), (1_505, 0.0)], "t BIGINT, v DOUBLE")
    assert rows(chart.to_view(df, frame), "x_px", "y_px") == [(0.0, 0.0), (50.5, 25.0)]
    px = spark.createDataFrame([(0.0,), (50.56,)], "px DOUBLE")
    assert rows(px.select(frame.time_at(F.col("px")))) == [(1_000,), (1_505,)]


def test_array_lines(points, rows):
    assert rows(chart.array_lines(points([(5, [1.0, 2.0])], "ARRAY<DOUBLE>")), "line", "n_lines", "t", "v") == [
        (0, 2, 5, 1.0), (1, 2, 5, 2.0)]


def test_overlay(spark, rows):
    catalog = spark.createDataFrame([("a", "num"), ("b", "num"), ("s", "str")], "series STRING, kind STRING")
    assert rows(chart.overlay(catalog, ["b", "a"]), "series") == [("a",), ("b",)]
    assert rows(chart.overlay(catalog, ["b", "s"], strict=False), "series", "accepted") == [("b", True), ("s", False)]
    with pytest.raises(Exception, match="cannot overlay"):
        chart.overlay(catalog, ["s", "a"]).collect()
    with pytest.raises(Exception, match="cannot overlay"):
        chart.overlay(catalog, ["s", "a"]).select("series").collect()


def test_every_kind_can_be_viewed(points, rows):
    text = pyr.build_pyramid(points([(i * 100, "on" if i < 30 else "off") for i in range(60)], "STRING"), "str", 8, 4)
    got = vw.view(text, vw.Viewport(0, 6_000, 30, 1_000))
    assert rows(got.groupBy("summary").agg(F.sum("n"))) == [(None, 4), ("off", 28), ("on", 28)]  # one leaf holds both
    arr = pyr.build_pyramid(points([(i * 100, [1.0, float(i)]) for i in range(60)], "ARRAY<DOUBLE>"), "arr", 8, 4)
    got = vw.view(arr, vw.Viewport(0, 6_000, 30, 1_000))
    assert got.agg(F.sum("n")).first()[0] == 120


def test_whole_series_from_the_top_nodes(pyramid, rows):
    for of in (agg.series_summary(pyramid), agg.time_extent(pyramid), agg.value_limits(pyramid, ["a"])):
        assert "/points" not in of._jdf.queryExecution().executedPlan().toString()
    assert rows(agg.time_extent(pyramid)) == rows(agg.time_extent(pyramid.points))
    columns = ["series", "min_t", "max_t", "lo", "hi", "n", "mean"]
    assert rows(agg.series_summary(pyramid), *columns) == rows(agg.series_summary(pyramid.points, "num"), *columns)
    assert rows(agg.value_limits(pyramid, ["a"])) == rows(agg.value_limits(pyramid.points, ["a"]))
