from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import calendar as cal
from tidegrid.plans.chart import axis_scales

UTC, CHICAGO = "UTC", "America/Chicago"


def ms(text, zone=UTC, fold=0):
    at = datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(zone), fold=fold)
    return round(at.timestamp() * 1000)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def lit(x):
    return F.lit(x).cast("long")


@pytest.mark.parametrize("scale, expected", [
    ("year_1000", "2000-01-01"), ("year_100", "2000-01-01"), ("year_10", "2020-01-01"), ("year_1", "2024-01-01"),
    ("month", "2024-07-01"), ("day", "2024-07-17"), ("hour_6", "2024-07-17T12:00"), ("hour", "2024-07-17T17:00"),
    ("minute_10", "2024-07-17T17:40"), ("minute", "2024-07-17T17:43"), ("second_10", "2024-07-17T17:43:20"),
    ("second", "2024-07-17T17:43:28"), ("ms_100", "2024-07-17T17:43:28.900"), ("ms_10", "2024-07-17T17:43:28.980"),
    ("ms", "2024-07-17T17:43:28.987")])
def test_truncation(spark, scale, expected):
    at = "2024-07-17T17:43:28.987"
    got = spark.range(1).select(*[cal.calendar_trunc(lit(ms(at, zone)), scale, zone) for zone in (UTC, CHICAGO)]).first()
    assert tuple(got) == (ms(expected, UTC), ms(expected, CHICAGO))


def test_before_the_epoch(spark):
    got = spark.range(1).select(*[cal.calendar_trunc(lit(ms("1969-06-15T13:14:15.016")), s)
                                  for s in ("year_10", "month", "hour_6", "minute_10", "ms_10")]).first()
    assert tuple(got) == tuple(ms(x) for x in ("1960-01-01", "1969-06-01", "1969-06-15T12:00",
                                               "1969-06-15T13:10", "1969-06-15T13:14:15.010"))


def test_repeated_hour_keeps_the_offset_of_finer_fields(spark):
    second = ms("2024-11-03T01:43:10", CHICAGO, fold=1)
    got = spark.range(1).select(*[cal.calendar_trunc(lit(second), s, CHICAGO) for s in ("minute_10", "hour", "day")])
    assert tuple(got.first()) == (ms("2024-11-03T01:40", CHICAGO, fold=1), ms("2024-11-03T01:00", CHICAGO, fold=0),
                                  ms("2024-11-03", CHICAGO))


def test_steps(spark):
    at = lit(ms("2024-01-31T10:00", CHICAGO))
    got = spark.range(1).select(cal.calendar_advance(at, "month", 1, CHICAGO), cal.calendar_advance(at, "year_10", 2, CHICAGO),
                                cal.calendar_advance(lit(ms("2024-03-09T10:00", CHICAGO)), "day", 1, CHICAGO),
                                cal.calendar_advance(lit(ms("2024-03-09T22:00", CHICAGO)), "hour_6", 1, CHICAGO)).first()
    assert tuple(got) == (ms("2024-02-29T10:00", CHICAGO), ms("2044-01-31T10:00", CHICAGO),
                          ms("2024-03-10T10:00", CHICAGO), ms("2024-03-10T05:00", CHICAGO))


def ticks(spark, start, end, scale, zone=UTC, **kw):
    df = spark.createDataFrame([(start, end)], "start BIGINT, end BIGINT")
    return sorted(r["tick"] for r in cal.tick_spine(df, scale, zone, **kw).collect())


def test_spine(spark):
    start, end = ms("2024-01-01T05:00"), ms("2024-01-02")
    six = [ms(f"2024-01-01T{h:02}:00") for h in (6, 12, 18)]
    assert ticks(spark, start, end, "hour_6") == six
    assert ticks(spark, start, end, "hour_6", prior=True) == [ms("2024-01-01"), *six]
    assert ticks(spark, six[0], end, "hour_6") == six[1:]  # a start on a tick is the prior
    assert ticks(spark, ms("2023-11-15"), ms("2024-03-01"), "month") == [ms("2023-12-01"), ms("2024-01-01"), ms("2024-02-01")]
    assert ticks(spark, ms("1995-05-05"), ms("2021-01-01"), "year_10") == [ms("2000-01-01"), ms("2010-01-01"), ms("2020-01-01")]
    assert ticks(spark, start, start, "ms") == []
    assert len(ticks(spark, start, start + 10_000, "ms")) == 9_999  # more than one block of steps


def test_spine_across_a_clock_change(spark):
    days = ticks(spark, ms("2024-03-09T12:00", CHICAGO), ms("2024-03-12", CHICAGO), "day", CHICAGO)
    assert days == [ms("2024-03-10", CHICAGO), ms("2024-03-11", CHICAGO)]
    hours = ticks(spark, ms("2024-03-10", CHICAGO), ms("2024-03-10T20:00", CHICAGO), "hour_6", CHICAGO)
    # steps of hours are elapsed time, so they sit an hour later after the change
    assert hours == [ms("2024-03-10T07:00", CHICAGO), ms("2024-03-10T13:00", CHICAGO), ms("2024-03-10T19:00", CHICAGO)]


def test_scales(spark, rows):
    expected = {0: "ms", 1: "ms_10", 99: "ms_100", 100: "second", 1000: "second_10", 59_999: "minute", 60_000: "minute_10",
                3_600_000: "hour_6", 86_399_999: "day", 86_400_000: "month", 31_536_000_000: "year_10", 2**60: "year_1000"}
    df = spark.createDataFrame([(k,) for k in expected], "span BIGINT")
    assert dict(rows(df.withColumn("s", cal.best_scale(F.col("span"))))) == expected
    names = spark.createDataFrame([(s.name,) for s in cal.SCALES], "s STRING")
    got = {r["s"]: (r["c"], r["f"]) for r in names.select(
        "s", cal.context_scale(F.col("s")).alias("c"), cal.finer_scale(F.col("s")).alias("f")).collect()}
    assert got["minute_10"] == ("hour", "minute") and got["second"] == ("minute", "ms") and got["ms"] == ("second", "ms")
    assert got["hour_6"] == ("day", "hour") and got["year_1000"] == ("year_1000", "year_100") and got["month"] == ("year_1", "day")
    day = spark.createDataFrame([(0, 86_400_000)], "start BIGINT, end BIGINT")
    assert rows(axis_scales(day, 960), "tick_scale", "context_scale", "finer_scale") == [("hour_6", "day", "hour")]


def test_scale_per_row(spark, rows):
    at = ms("2024-07-17T17:43:28.987")
    df = spark.createDataFrame([("month",), ("hour",), ("none",)], "s STRING")
    got = df.select("s", cal.calendar_trunc(lit(at), F.col("s")).alias("t"), cal.tick_label(lit(at), F.col("s")).alias("l"))
    assert rows(got) == [("hour", ms("2024-07-17T17:00"), "17 h"), ("month", ms("2024-07-01"), "Jul"), ("none", None, None)]


def test_labels(spark):
    t = lit(ms("2024-07-07T05:03:09.045", CHICAGO))
    full = [cal.tick_label(t, s, CHICAGO, full=True) for s in ("year_1", "month", "day", "hour", "minute", "second", "ms")]
    assert tuple(spark.range(1).select(*full).first()) == (
        "2024 [CDT / -05]", "2024 Jul [CDT / -05]", "2024 Jul 7 (Sun) [CDT / -05]", "2024 Jul 7 (Sun)  05 h [CDT / -05]",
        "2024 Jul 7 (Sun)  05:03 [CDT / -05]", "2024 Jul 7 (Sun)  05:03:09 [CDT / -05]",
        "2024 Jul 7 (Sun)  05:03:09.0450 [CDT / -05]")
    short = [cal.tick_label(t, s, CHICAGO) for s in ("year_10", "month", "day", "hour_6", "minute", "second", "ms_10")]
    assert tuple(spark.range(1).select(*short).first()) == ("2024 y", "Jul", "7 d (Sun)", "05 h", "03 m", "09 s", "045 ms")
    # the year of the day, not of its week
    assert one(spark, cal.tick_label(lit(ms("2024-12-30")), "year_1")) == "2024 y"


def test_midpoints(spark, rows):
    start, end = ms("2024-01-01T12:00"), ms("2024-01-03T06:00")
    df = spark.createDataFrame([(start, end)], "start BIGINT, end BIGINT")
    assert rows(cal.label_midpoints(df, "day"), "tick", "mid") == [
        (ms("2024-01-01"), ms("2024-01-01T18:00")), (ms("2024-01-02"), ms("2024-01-02T12:00")),
        (ms("2024-01-03"), ms("2024-01-03T03:00"))]


def test_rollup_is_dense(points, rows):
    df = points([(ms("2024-01-01T05:10"), 1), (ms("2024-01-01T05:50"), 3), (ms("2024-01-01T08:00"), 5)])
    assert rows(cal.calendar_rollup(df, "hour"), "t", "n", "total") == [
        (ms("2024-01-01T05:00"), 2, 4.0), (ms("2024-01-01T06:00"), 0, None), (ms("2024-01-01T07:00"), 0, None),
        (ms("2024-01-01T08:00"), 1, 5.0)]


@pytest.mark.parametrize("scale", ["hour", "hour_6", "day"])
def test_rollup_across_clock_changes_loses_nothing(spark, points, scale):
    for first in "2024-03-09", "2024-11-02":
        begin = ms(first, CHICAGO)
        df = points([(begin + i * 1_800_000, 1) for i in range(2 * 48 + 5)])
        got = cal.calendar_rollup(df, scale, zone=CHICAGO)
        assert got.agg(F.sum("n")).first()[0] == 2 * 48 + 5
        assert got.groupBy("series", "t").count().filter("count > 1").count() == 0
        assert got.filter("n = 0").count() == 0


def test_zoned(spark):
    t = ms("2024-03-10T03:30:00.123", CHICAGO)
    wall = one(spark, cal.to_zoned(lit(t), CHICAGO))
    assert wall == datetime(2024, 3, 10, 3, 30, 0, 123000)
    assert one(spark, cal.from_zoned(cal.to_zoned(lit(t), CHICAGO), CHICAGO)) == t
    assert timedelta(milliseconds=t) + datetime(1970, 1, 1, tzinfo=timezone.utc) == datetime(
        2024, 3, 10, 8, 30, 0, 123000, tzinfo=timezone.utc)


def test_other_session_zone_changes_nothing(spark):
    t = lit(ms("2024-07-17T17:43:28.987", CHICAGO))
    columns = [cal.calendar_trunc(t, "day", CHICAGO), cal.tick_label(t, "day", CHICAGO, full=True),
               cal.calendar_advance(t, "month", 1, CHICAGO)]
    want = tuple(spark.range(1).select(*columns).first())
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert tuple(spark.range(1).select(*columns).first()) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_user_scale(spark):
    quarter = cal.CalendarScale("quarter", "month", 3, "MMM", span_ms=90 * cal.DAY_MS)
    assert quarter.nominal_ms == 90 * 86_400_000
    assert one(spark, cal.calendar_trunc(lit(ms("2024-08-20")), quarter)) == ms("2024-07-01")
    assert ticks(spark, ms("2024-02-01"), ms("2024-12-01"), quarter) == [ms("2024-04-01"), ms("2024-07-01"), ms("2024-10-01")]


def test_long_ranges_are_filled_by_many_tasks(spark):
    """Minutes of 30 days for 20 series: the ticks do not come from the task that holds the 20 ranges."""
    day = 86_400_000
    df = spark.createDataFrame([(f"s{i}", i * 60_000, 30 * day) for i in range(20)], "series STRING, start BIGINT, end BIGINT")
    ticks = cal.tick_spine(df, "minute")
    per_task = ticks.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(per_task) > 1 and sum(r["count"] for r in per_task) == ticks.count()
