import random
import re

import pytest
from pyspark.sql import functions as F

from tidegrid.operators.scan import (last_before, max_before, next_after, ordered_scan, split_by, total_all,
                                     total_before)


@pytest.mark.parametrize("bits", [1, 3, 10, 40])
def test_carries_equal_a_walk_over_the_series(spark, rows, bits):
    rnd = random.Random(bits)
    data = [(s, o, rnd.randint(-50, 50), rnd.choice([None, o])) for s in "ab"
            for o in sorted(rnd.sample(range(-200, 400), 150))]
    df = spark.createDataFrame(data, "series STRING, o BIGINT, x BIGINT, y BIGINT").repartition(5)
    got = ordered_scan(df, ["series"], "o", {
        "s": total_before(F.col("x")), "m": max_before(F.col("x")), "p": last_before(F.col("y")),
        "q": next_after(F.col("y")), "n": total_all(F.lit(1).cast("long"))}, bits)
    expected = []
    for s in "ab":
        mine = [r for r in data if r[0] == s]
        for i, r in enumerate(mine):
            seen = [x for _, _, x, _ in mine[:i]]
            past = [y for *_, y in mine[:i] if y is not None]
            later = [y for *_, y in mine[i + 1:] if y is not None]
            expected.append((*r, sum(seen), max(seen, default=None), past[-1] if past else None,
                             later[0] if later else None, len(mine)))
    key = lambda r: r[:2]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(expected, key=key)


def chunks(spark, values, rule, needs=("x",), bits=2, prepare=lambda df: df):
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(values)], "series STRING, o BIGINT, x INT")
    got = split_by(prepare(df), ["series"], "o", list(needs), rule, "g", bits).orderBy("o").collect()
    groups = {}
    for r in got:
        groups.setdefault(r["g"], []).append(r["x"])
    return [groups[g] for g in sorted(groups)]


@pytest.mark.parametrize("bits", [1, 2, 20])
def test_split_examples(spark, bits):
    values = [7, 4, 4, 9, 6]
    assert chunks(spark, values, lambda p, c: F.lit(False), bits=bits) == [[7, 4, 4, 9, 6]]
    assert chunks(spark, values, lambda p, c: c["x"] == 9, bits=bits) == [[7, 4, 4], [9, 6]]
    assert chunks(spark, values, lambda p, c: c["x"].isin(4, 6), bits=bits) == [[7], [4], [4, 9], [6]]
    assert chunks(spark, values, lambda p, c: F.lit(True), bits=bits) == [[7], [4], [4], [9], [6]]
    # state carried from row to row: a running count
    counted = lambda df: ordered_scan(df, ["series"], "o", {"k": total_before(F.lit(1).cast("long"))}, bits)
    assert chunks(spark, values, lambda p, c: c["k"] == 1, ("k",), bits, counted) == [[7], [4, 4, 9, 6]]


def test_split_of_nothing(spark):
    assert chunks(spark, [], lambda p, c: F.lit(True)) == []


@pytest.mark.parametrize("bits", [1, 4, 30])
def test_split_equals_plain_walk(spark, bits):
    rnd = random.Random(7)
    values = [rnd.randint(0, 3) for _ in range(300)]
    expected, group = [], []
    for i, x in enumerate(values):
        if group and x < values[i - 1]:
            expected.append(group)
            group = []
        group.append(x)
    expected.append(group)
    assert chunks(spark, values, lambda p, c: c["x"] < p["x"], bits=bits) == expected


def test_slabs_not_series_bound_the_tasks(spark):
    """A series that holds all rows is spread over slabs: no window is partitioned by series over the rows."""
    df = spark.range(1000).select((F.col("id") % 1).cast("string").alias("series"), F.col("id").alias("t"))
    plan = ordered_scan(df, ["series"], "t", {"m": max_before(F.col("t"))}, 4)._jdf.queryExecution().optimizedPlan()
    specs = re.findall(r"windowspecdefinition\((series#\d+), (_slab#\d+L)(, t#\d+L)? ASC", plan.toString())
    # inside a slab, and over the slabs' summaries ordered by slab
    assert sorted(bool(in_slab) for *_, in_slab in specs) == [False, True]
