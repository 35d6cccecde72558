import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators.intervals import merge_intervals
from tidegrid.operators.sections import runs_by_kind, section_bounds, section_by_gap


def spans(spark, items, series="s"):
    return spark.createDataFrame([(series, a, b) for a, b in items], "series STRING, min_t BIGINT, max_t BIGINT")


@pytest.mark.parametrize("bits", [None, 1, 3, 22])
def test_gap_is_strict(spark, rows, bits):
    df = spans(spark, [(0, 1), (6, 7), (13, 13), (18, 18), (24, 24)])
    got = section_by_gap(df, 5, bits=bits)
    assert rows(got, "min_t", "section_id") == [(0, 0), (6, 0), (13, 1), (18, 1), (24, 2)]
    assert rows(section_bounds(got), "section_id", "min_t", "max_t", "n_rows") == [
        (0, 0, 7, 2), (1, 13, 18, 2), (2, 24, 24, 1)]


@pytest.mark.parametrize("bits", [2, 6])
def test_equal_to_a_walk(spark, rows, bits):
    rnd, t, items = random.Random(bits), -100, []
    for _ in range(300):
        t += rnd.choice([1, 2, 5, 6, 9])
        end = t + rnd.choice([0, 0, 3])
        items.append((t, end))
        t = end
    expected, section = [], 0
    for i, (a, b) in enumerate(items):
        if i and a > items[i - 1][1] + 5:
            section += 1
        expected.append((a, b, section))
    assert rows(section_by_gap(spans(spark, items), 5, bits=bits), "min_t", "max_t", "section_id") == expected


def test_one_series_holding_most_rows(spark):
    """A hot series and many small ones; sections of the hot one span many slabs."""
    hot = spark.range(0, 20000).select(F.lit("hot").alias("series"), (F.col("id") * 3 + F.when(
        F.col("id") >= 12345, 1000).otherwise(0)).alias("min_t"))
    cold = spark.range(0, 900).select(F.concat(F.lit("c"), F.col("id") % 300).alias("series"),
                                      (F.col("id") * 100).alias("min_t"))
    df = hot.unionByName(cold).withColumn("max_t", F.col("min_t"))
    got = section_bounds(section_by_gap(df, 10, bits=8))
    assert sorted(r["n_rows"] for r in got.filter("series = 'hot'").collect()) == [7655, 12345]
    assert got.filter("series <> 'hot'").count() == 900


def test_runs(spark, rows):
    flags = [True, True, False, False, True]
    df = spark.createDataFrame([("s", 0, i, f) for i, f in enumerate(flags)] + [("s", 1, 9, True)],
                               "series STRING, section_id BIGINT, min_t BIGINT, is_leaf BOOLEAN")
    expected = [(0, 0, 0), (0, 1, 0), (0, 2, 1), (0, 3, 1), (0, 4, 2), (1, 9, 0)]
    for bits in None, 1, 22:
        assert rows(runs_by_kind(df, bits), "section_id", "min_t", "run_id") == expected


@pytest.mark.parametrize("centres, expected", [
    ([0, 10, 20], [(-5, 5, 1), (5, 15, 1), (15, 25, 1)]), ([10, 10], [(5, 15, 2)]), ([15, 15, 15], [(10, 20, 3)]),
    ([14, 15, 16], [(9, 21, 3)]), ([], [])])
def test_merge_examples(spark, rows, centres, expected):
    df = spans(spark, [(c - 5, c + 5) for c in centres])
    assert rows(merge_intervals(df, bits=2), "min_t", "max_t", "n") == expected


@pytest.mark.parametrize("bits", [1, 4, 22])
def test_merge_equals_a_walk(spark, rows, bits):
    rnd = random.Random(bits)
    items = [(a, a + rnd.randint(1, 12)) for a in (rnd.randint(-300, 900) for _ in range(250))]
    groups = []
    for a, b in sorted(items):
        if groups and a < groups[-1][1]:
            groups[-1] = (groups[-1][0], max(groups[-1][1], b), groups[-1][2] + 1)
        else:
            groups.append((a, b, 1))
    assert rows(merge_intervals(spans(spark, items), bits=bits), "min_t", "max_t", "n") == groups


def test_merge_without_length(spark, rows):
    df = spans(spark, [(5, 5), (5, 5), (5, 10), (7, 7), (10, 10)])
    assert rows(merge_intervals(df, bits=1), "min_t", "max_t", "n") == [(5, 5, 2), (5, 10, 2), (10, 10, 1)]
