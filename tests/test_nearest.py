import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators.nearest import (cursor_readout, nearest_interval_join, nearest_value, snap_tolerance,
                                        value_order)
from tidegrid.operators.resample import resample_points
from tidegrid.operators.sections import section_by_gap

FAR = 2**31 - 1
INTERVALS = [(30, 34), (51, 58), (77, 77)]


def find(spark, probes, tolerance, intervals=INTERVALS, bits=3):
    """(probe, kind, interval index, distance) of every probe that finds something."""
    iv = spark.createDataFrame([("s", *x) for x in intervals], "series STRING, min_t BIGINT, max_t BIGINT")
    pr = spark.createDataFrame([("s", t) for t in probes], "series STRING, t BIGINT")
    got = nearest_interval_join(pr, iv, tolerance, bits=bits).collect()
    return sorted((r["t"], r["kind"], intervals.index((r["min_t"], r["max_t"])), r["distance"]) for r in got)


def test_contained(spark):
    assert find(spark, [34, 77, 30, 51, 32], 0) == [(30, "contained", 0, 0), (32, "contained", 0, 0), (34, "contained", 0, 0),
                                                    (51, "contained", 1, 0), (77, "contained", 2, 0)]


def test_before_and_after(spark):
    assert find(spark, [78, 900, 36, 64], FAR) == [(36, "before", 0, 2), (64, "before", 1, 6), (78, "before", 2, 1),
                                                   (900, "before", 2, 823)]
    assert find(spark, [70, 29, -400, 47], FAR) == [(-400, "after", 0, 430), (29, "after", 0, 1), (47, "after", 1, 4),
                                                    (70, "after", 2, 7)]


def test_tolerance_edges(spark):
    assert find(spark, [900, -400], 823) == [(-400, "after", 0, 430), (900, "before", 2, 823)]
    assert find(spark, [900], 822) == [] and find(spark, [-400], 429) == []


def test_tie_goes_to_after(spark):
    assert find(spark, [40], 9, [(30, 34), (46, 50)]) == [(40, "after", 1, 6)]


def brute(probes, intervals, tolerance):
    out = []
    for t in probes:
        best = min(((max(a - t, t - b, 0), -a, (a, b)) for a, b in intervals), default=None)
        if best and best[0] <= (tolerance if best[0] else max(tolerance, 0)):
            a, b = best[2]
            out.append((t, "contained" if a <= t <= b else "before" if b < t else "after", intervals.index((a, b)), best[0]))
    return sorted(out)


@pytest.mark.parametrize("bits, tolerance", [(1, 4), (4, FAR), (22, 0)])
def test_equals_brute_force(spark, bits, tolerance):
    rnd, t, intervals = random.Random(bits), 0, []
    for _ in range(60):
        t += rnd.randint(1, 20)
        intervals.append((t, t + rnd.choice([0, 3, 30])))
        t = intervals[-1][1] + 1
    probes = [rnd.randint(-50, t + 50) for _ in range(300)] + [7] * 50  # one time asked for many times
    assert find(spark, probes, tolerance, intervals, bits) == brute(probes, intervals, tolerance)


def test_every_series_keeps_to_its_own(spark, rows):
    iv = spark.createDataFrame([("a", 0, 1), ("b", 100, 101)], "series STRING, min_t BIGINT, max_t BIGINT")
    pr = spark.createDataFrame([("a", 99, 1), ("b", 2, 2), ("c", 0, 3)], "series STRING, t BIGINT, id INT")
    assert rows(nearest_interval_join(pr, iv, 1000), "id", "kind", "distance") == [(1, "before", 98), (2, "after", 98)]
    own = pr.withColumn("tol", F.when(F.col("id") == 1, 97).otherwise(98))
    assert rows(nearest_interval_join(own, iv, F.col("tol")), "id") == [(2,)]


def test_readout(spark, points, rows):
    df = points([(0, 1.5), (100, 2), (101, 4), (5000, 7)])
    view = section_by_gap(resample_points(df, 10), 1000)
    pr = spark.createDataFrame([("s", 1), ("s", 103), ("s", 3000), ("other", 0)], "series STRING, t BIGINT")
    got = cursor_readout(pr, view, 50)
    assert rows(got, "t", "value", "text", "section_id") == [(1, 1.5, "s = 1.5000", 0), (103, 3.0, "s = (3.0000)", 0)]
    assert [r["value"] for r in value_order(got).collect()] == [3.0, 1.5]
    assert rows(nearest_value(pr, view, 50), "t", "is_leaf", "n") == [(1, True, 1), (103, False, 2)]


def test_readout_of_arrays(spark, points, rows):
    df = points([(0, [1.0, 2.0]), (100, [3.0, 4.0]), (101, [5.0, 8.0])], "ARRAY<DOUBLE>")
    view = section_by_gap(resample_points(df, 10, "arr"), 1000)
    pr = spark.createDataFrame([("s", 1), ("s", 99)], "series STRING, t BIGINT")
    assert rows(cursor_readout(pr, view, 50, "arr"), "t", "label", "value", "text") == [
        (1, "s0", 1.0, "s0 = 1.0000"), (1, "s1", 2.0, "s1 = 2.0000"), (99, "s", 5.0, "s = (5.0000)")]


def test_snap_tolerance(spark):
    df = spark.createDataFrame([(0, 1000), (0, 86_400_000)], "a BIGINT, b BIGINT")
    assert [r[0] for r in df.select(snap_tolerance(F.col("a"), F.col("b"), 1280)).collect()] == [12, 1080000]
