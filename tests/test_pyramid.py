import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import lod, points as pts, pyramid as pyr
from tidegrid.session import materialize


def held(p):
    """The pyramid written out, as an append or a query finds it."""
    return pyr.Pyramid(materialize(p.points, "p"), materialize(p.nodes, "n"), p.spec, p.shape)


def built(points, n, leaf=4, fanout=4, bits=2):
    return held(pyr.build_pyramid(points([(i, i) for i in range(n)]), "num", leaf, fanout, bits=bits))


@pytest.mark.parametrize("leaf, fanout, n, depth", [
    (4, 4, 4, 1), (4, 4, 5, 2), (4, 4, 10, 2), (4, 4, 11, 3), (4, 4, 22, 3), (4, 4, 23, 4),
    (16, 16, 1096, 3), (16, 16, 1097, 4)])
def test_depth_and_consistency(points, rows, leaf, fanout, n, depth):
    p = built(points, n, leaf, fanout, bits=5)
    assert rows(pyr.pyramid_stats(p.nodes), "depth", "n") == [(depth, n)]
    assert rows(p.nodes.filter("parent_id is null"), "min_t", "max_t", "n") == [(0, n - 1, n)]
    assert rows(pyr.validate_pyramid(p)) == []


def test_leaf_shape(points, rows):
    assert rows(built(points, 10).nodes.filter("level = 0"), "node_id", "n") == [(0, 2), (1, 2), (2, 2), (3, 4)]


@pytest.mark.parametrize("leaf, fanout, ns", [(4, 4, (1, 4, 5, 9, 17, 64, 333)), (8, 4, (8, 9, 50, 200)), (16, 16, (16, 40, 700))])
def test_nodes_are_half_full_but_the_last(points, rows, leaf, fanout, ns):
    for n in ns:
        nodes = built(points, n, leaf, fanout, bits=5).nodes.orderBy("level", "node_id").collect()
        levels = [[x for x in nodes if x["level"] == j] for j in range(nodes[-1]["level"] + 1)]
        assert len(levels[-1]) == 1 and all(len(x) > 1 for x in levels[:-1])
        assert [sum(x["n_points"] for x in level) for level in levels] == [n] * len(levels)
        for j, level in enumerate(levels):
            sizes = ([x["n_points"] for x in level] if j == 0 else
                     [sum(c["parent_id"] == x["node_id"] for c in levels[j - 1]) for x in level])
            most = leaf if j == 0 else fanout
            assert all(size == most // 2 for size in sizes[:-1])
            assert sizes[-1] <= most and (len(level) == 1 or sizes[-1] > most // 2 - 1)


TIMES = [5, 6, 9, 40, 41, 43, 44, 300, 301, 302, 310, 311, 340, 900, 905, 906, 2000, 2001, 2002, 2003, 2500]


def assert_covers(found, nodes, times, start, end, resolution):
    """What a range query promises: whole nodes that fit under parents that do not, and every point of the range once."""
    parents = {(x["level"], x["node_id"]): x["max_t"] - x["min_t"] for x in nodes}
    covered = []
    for is_leaf, low, high in found:
        if is_leaf:
            assert low == high and start <= low <= end
            covered.append(low)
            continue
        assert high - low <= resolution and high >= start and low < end
        same = [x for x in nodes if (x["min_t"], x["max_t"]) == (low, high)]
        top = max(same, key=lambda x: x["level"])
        assert top["parent_id"] is None or parents[top["level"] + 1, top["parent_id"]] > resolution
        covered += [t for t in times if low <= t <= high]
    assert len(covered) == len(set(covered))
    inside = {t for t in times if start <= t < end}
    assert inside <= set(covered)


@pytest.mark.parametrize("start, end, resolution", [
    (0, 3000, 50), (41, 310, 5), (42, 42, 3), (300, 2001, 700), (6, 905, 0), (-10, 4, 50), (2600, 9000, 50), (0, 3000, 5000)])
def test_range_query(spark, points, rows, start, end, resolution):
    p = held(pyr.build_pyramid(points([(t, i) for i, t in enumerate(TIMES)]), "num", 4, 4, bits=3))
    columns = ["is_leaf", "min_t", "max_t"]
    found = rows(lod.query_lod(p, start, end, resolution), *columns)
    assert_covers(found, p.nodes.collect(), TIMES, start, end, resolution)
    ranges = spark.createDataFrame([("s", start, end, resolution), ("other", 0, 1, 1)],
                                   "series STRING, start BIGINT, end BIGINT, resolution BIGINT")
    assert rows(lod.query_lod(p, ranges=ranges), *columns) == found
    assert rows(lod.query_lod(p, start, end, resolution, look_ahead=True), *columns) == found
    assert rows(lod.query_lod(p, ranges=ranges, look_ahead=True), *columns) == found


def test_range_query_without_a_range(points, rows):
    p = held(pyr.build_pyramid(points([(t, i) for i, t in enumerate(TIMES)]), "num", 4, 4))
    assert rows(lod.query_lod(p, resolution=5)) == rows(lod.query_lod(p, -100, 100_000, 5)) != []
    with pytest.raises(ValueError, match="resolution"):
        lod.query_lod(p, 0, 10)


def test_look_ahead_leaves_the_points_alone(points, rows, monkeypatch):
    p = held(pyr.build_pyramid(points([(t, i) for i, t in enumerate(TIMES)]), "num", 4, 4))
    coarse = lod.query_lod(p, 0, 3000, 9000, look_ahead=True)
    assert coarse._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert rows(coarse) == rows(lod.query_lod(p, 0, 3000, 9000))
    monkeypatch.setattr(lod, "FEW_LEAVES", 0)  # too many to broadcast
    assert rows(lod.query_lod(p, 0, 3000, 3, look_ahead=True)) == rows(lod.query_lod(p, 0, 3000, 3))


def test_range_queries_of_random_times(spark, points, rows):
    rnd, t, times = random.Random(3), 0, []
    for _ in range(220):
        t += rnd.choice([1, 1, 2, 3, 40])
        times.append(t)
    p = held(pyr.build_pyramid(points([(t, 1) for t in times]), "num", 4, 4, bits=4))
    nodes = p.nodes.collect()
    for _ in range(6):
        a, b = sorted(rnd.sample(range(t), 2))
        r = rnd.choice([-1, 0, 3, 10, 60, 500])
        assert_covers(rows(lod.query_lod(p, a, b, r), "is_leaf", "min_t", "max_t"), nodes, times, a, b, r)


def test_negative_resolution_gives_raw_points(points, rows):
    df = points([(i * 3, i) for i in range(40)])
    p = pyr.build_pyramid(df, "num", 4, 4)
    got = lod.query_lod(p, 10, 61, -1)  # a leaf beginning at the end itself would be left out
    assert rows(got, "min_t") == rows(pts.range_points(df, 10, 61), "t")


@pytest.mark.parametrize("old, new", [(4, 1), (10, 1), (10, 200), (150, 3), (0, 9)])
def test_append_equals_building_at_once(spark, points, rows, old, new):
    both = points([(i * 2, i) for i in range(old + new)])
    other = points([(5, 1.0), (6, 2.0)], series="untouched")
    early = both.filter(F.col("t") < old * 2)
    late = both.filter(F.col("t") >= max(0, old * 2 - 6)).withColumn("pos", F.col("t"))  # overlaps what is held
    first = held(pyr.build_pyramid(early.unionByName(other), "num", 4, 4))
    delta = held(pyr.append_delta(first, late, "pos", bits=3))
    got = held(pyr.upsert(first, delta))
    assert delta.points.count() <= new + 4 and delta.nodes.filter("series = 'untouched'").count() == 0
    want = pyr.build_pyramid(both.unionByName(other), "num", 4, 4)
    assert rows(got.nodes, *want.nodes.columns) == rows(want.nodes)
    assert rows(got.points, *want.points.columns) == rows(want.points)
    assert rows(pyr.validate_pyramid(got)) == []


@pytest.mark.parametrize("kind, type_, value", [("str", "STRING", lambda i: "a" if i < 25 else "b"),
                                                ("arr", "ARRAY<DOUBLE>", lambda i: [float(i), 1.0, -1.0])])
def test_append_of_other_kinds(points, rows, kind, type_, value):
    both = points([(i, value(i)) for i in range(60)], type_)
    first = held(pyr.build_pyramid(both.filter("t < 37"), kind, 4, 4))
    got = pyr.append_points(first, both.filter("t >= 37").withColumn("pos", F.col("t")), "pos")
    want = pyr.build_pyramid(both, kind, 4, 4)
    assert rows(got.nodes, *want.nodes.columns) == rows(want.nodes)


def test_validate_finds_damage(points, rows):
    p = built(points, 40)
    damaged = [("aggregate", F.col("total") + F.when((F.col("level") == 1) & (F.col("node_id") == 0), 1.0).otherwise(0.0), "total"),
               ("bounds", F.col("max_t") + F.when((F.col("level") == 0) & (F.col("node_id") == 3), 1).otherwise(0), "max_t")]
    for problem, change, column in damaged:
        bad = pyr.Pyramid(p.points, p.nodes.withColumn(column, change), p.spec, p.shape)
        assert problem in {r[0] for r in rows(pyr.validate_pyramid(bad), "problem")}
    bad = pyr.Pyramid(p.points, p.nodes.filter("level > 0 or node_id <> 2"), p.spec, p.shape)
    assert {"missing", "bounds", "aggregate"} & {r[0] for r in rows(pyr.validate_pyramid(bad), "problem")}
    small = pyr.Pyramid(p.points, p.nodes, p.spec, pyr.CountShape(2, 4))
    assert "size" in {r[0] for r in rows(pyr.validate_pyramid(small), "problem")}


def test_time_pyramid_and_append(points, rows):
    df = points([(i * 7, i) for i in range(100)])
    whole = pyr.build_time_pyramid(df, "num", 10, 4, 4)
    first = pyr.build_time_pyramid(df.filter("t < 333"), "num", 10, 4, 4)
    grown = pyr.append_time_points(first, df.filter("t >= 333"))
    assert rows(grown.nodes, *whole.nodes.columns) == rows(whole.nodes)
    assert rows(whole.nodes.groupBy("level").agg(F.sum("n").alias("n"))) == [(j, 100) for j in range(4)]
    got = lod.query_lod(whole, 0, 700, 35)
    assert got.agg(F.sum("n")).first()[0] == 100
    assert got.filter(F.col("max_t") - F.col("min_t") > 35).count() == 0


def test_other_kinds(points, rows):
    text = pyr.build_pyramid(points([(i, "a" if i < 6 else "b") for i in range(12)], "STRING"), "str", 4, 4)
    assert rows(text.nodes.filter("parent_id is null"), "n", "summary") == [(12, None)]
    assert rows(text.nodes.filter("level = 0"), "n", "summary") == [(2, "a"), (2, "a"), (2, "a"), (2, "b"), (4, "b")]
    arr = pyr.build_pyramid(points([(i * 10, [float(i), -1.0]) for i in range(9)], "ARRAY<DOUBLE>"), "arr", 4, 4)
    got = lod.query_lod(arr, 0, 100, 5)
    assert rows(got, "is_leaf", "v") == [(True, [float(i), -1.0]) for i in range(9)]


def test_shape_limits():
    with pytest.raises(ValueError):
        pyr.CountShape(1, 4)
    with pytest.raises(ValueError):
        pyr.CountShape(4, 3)


def test_appending_keeps_the_shape(points, rows):
    both = points([(i, i) for i in range(100)])
    first = held(pyr.build_pyramid(both.filter("t < 60"), "num", 8, 4))
    grown = pyr.append_points(first, both.filter("t >= 60").withColumn("pos", F.col("t")), "pos")
    assert grown.nodes.filter("level = 0").agg(F.sum("n")).first()[0] == 100
    with pytest.raises(ValueError, match="GridShape"):
        pyr.append_time_points(first, both)
