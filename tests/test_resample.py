import random

import pytest
from pyspark.sql import functions as F

from tidegrid.model import lift_points
from tidegrid.operators.resample import min_resolution, resample, resample_points, tumble

NODE = "series STRING, is_leaf BOOLEAN, min_t BIGINT, max_t BIGINT, lo DOUBLE, hi DOUBLE, n BIGINT, total DOUBLE"
COLUMNS = ["is_leaf", "min_t", "max_t", "lo", "hi", "n", "total"]


def nodes(spark, *items):
    return spark.createDataFrame([("s", *i) for i in items], NODE)


def test_nodes(spark, rows):
    df = nodes(spark, (False, 10, 12, 1.0, 4.0, 3, 7.0), (False, 13, 14, 2.0, 9.0, 2, 11.0),
               (False, 21, 24, -5.0, 6.0, 4, 3.0))
    assert rows(resample(df, 5), *COLUMNS) == [(False, 10, 14, 1.0, 9.0, 5, 18.0), (False, 21, 24, -5.0, 6.0, 4, 3.0)]


def test_points(points, rows):
    df = points([(0, 7), (2, 1), (3, 4), (4, 4), (5, 2), (11, 3)])
    expected = sorted([(False, 0, 2, 1.0, 7.0, 2, 8.0), (False, 3, 5, 2.0, 4.0, 3, 10.0), (True, 11, 11, 3.0, 3.0, 1, 3.0)])
    assert rows(resample_points(df, 3), *COLUMNS) == expected
    assert rows(resample(lift_points(df, "num"), 3), *COLUMNS) == expected


def test_a_row_across_a_multiple_stays_alone(spark, rows):
    df = nodes(spark, (True, 1, 1, 5.0, 5.0, 1, 5.0), (False, 4, 6, 2.0, 3.0, 2, 5.0), (False, 8, 12, 7.0, 8.0, 3, 22.0),
               (True, 14, 14, 1.0, 1.0, 1, 1.0))
    assert rows(resample(df, 10), "min_t", "max_t", "n") == [(1, 6, 3), (8, 12, 3), (14, 14, 1)]


@pytest.mark.parametrize("r", [1, 3, 7, 20])
def test_rows_of_one_bucket_become_one(spark, rows, r):
    rnd, t, spans = random.Random(r), 0, []
    for _ in range(400):
        t += rnd.randint(1, 6)
        end = t + rnd.choice([0, 0, 1, 4, 15])
        spans.append((t, end))
        t = end
    df = nodes(spark, *[(lo == hi, lo, hi, 0.0, 0.0, 1, 0.0) for lo, hi in spans])
    found = rows(resample(df, r), "min_t", "max_t", "n")
    assert sum(n for _, _, n in found) == len(spans)
    inside = [(lo, hi) for lo, hi in spans if lo // r == hi // r]
    for low, high, n in found:
        if low // r != high // r:  # across a multiple: as it came
            assert n == 1 and (low, high) in spans
        else:  # all that lie in its bucket
            own = [x for x in inside if x[0] // r == low // r]
            assert n == len(own) and low == own[0][0] and high == own[-1][1]


def test_not_positive_resolution_merges_nothing(points, rows):
    df = lift_points(points([(1, 1), (2, 2)]), "num")
    assert rows(resample(df, 0)) == rows(df)
    assert rows(resample(df.withColumn("r", F.lit(0).cast("long")), F.col("r")), "min_t", "n") == [(1, 1), (2, 1)]


def test_negative_times_use_floor(points, rows):
    df = points([(-3, 1), (-2, 1), (-1, 1), (0, 1), (1, 1)])
    assert rows(resample_points(df, 2), "min_t", "max_t") == [(-3, -3), (-2, -1), (0, 1)]


def test_keeps_count_and_total(points):
    df = points([(i * 7 % 1000 + i, i) for i in range(500)])
    got = resample_points(df, 37).agg(F.sum("n"), F.sum("total")).first()
    assert tuple(got) == (500, sum(range(500)))


def test_arrays_and_strings(points, rows):
    arr = points([(0, [1.0, 2.0]), (1, [3.0, -4.0]), (9, [5.0, 6.0])], "ARRAY<DOUBLE>")
    assert rows(resample_points(arr, 5, "arr"), "min_t", "max_t", "lo", "hi", "n", "total", "v") == [
        (0, 1, -4.0, 3.0, 4, 2.0, None), (9, 9, 5.0, 6.0, 2, 11.0, [5.0, 6.0])]
    text = points([(0, "a"), (1, "a"), (5, "a"), (6, "b"), (10, "c")], "STRING")
    assert rows(resample_points(text, 5, "str"), "is_leaf", "min_t", "n", "summary") == [
        (False, 0, 2, "a"), (False, 5, 2, None), (True, 10, 1, "c")]


def test_tumble(points, rows):
    assert rows(tumble(points([(1, 1), (2, 2), (11, 3)]), 10), "t", "n", "total") == [(0, 2, 3.0), (10, 1, 3.0)]


def test_min_resolution(spark):
    df = spark.createDataFrame([(0, 1000), (500, 86_400_500)], "a BIGINT, b BIGINT")
    got = [r[0] for r in df.select(min_resolution(F.col("a"), F.col("b"), 1280)).collect()]
    assert got == [2, 202500]
