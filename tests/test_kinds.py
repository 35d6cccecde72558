import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from tidegrid.functions.calendar import Scale, calendar_rollup  # noqa: F401
from tidegrid.model import AggregateSpec
from tidegrid.operators import aggregates as agg, lod, pyramid as pyr, resample as rs
from tidegrid.operators.kinds import ENDS, TIME_WEIGHTED, quantile, sketches, trend
from tidegrid.plans.view import Viewport, view
from tidegrid.session import materialize, new_folder
from tidegrid.sources.store import read_pyramid, store_pyramid


def data(n=400, seed=1):
    rnd = random.Random(seed)
    t, out = 1_700_000_000_000, []
    for _ in range(n):
        t += rnd.choice([1, 5, 40, 900, 7000])
        out.append((t, rnd.gauss(50, 20)))
    return out


def area(pairs, low, high):
    """Of the points with low <= t <= high: how long each value lasts, and the sum of value times that."""
    held = total = 0
    for (t, v), (after, _) in zip(pairs, pairs[1:]):
        if low <= t <= high:
            held, total = held + after - t, total + v * (after - t)
    return held, total


@pytest.fixture
def frame(spark):
    def make(series):
        rows = [(s, t, v) for s, pairs in series.items() for t, v in pairs]
        return spark.createDataFrame(rows, "series STRING, t BIGINT, v DOUBLE").repartition(4)
    return make


def test_time_weighted_mean_from_points_and_nodes(frame):
    series = {"a": data(), "b": data(37, 2), "one": [(5, 1.0)]}
    points = frame(series)
    for summary in (agg.series_summary(points, TIME_WEIGHTED), agg.series_summary(pyr.build_pyramid(points, TIME_WEIGHTED, 4, 4))):
        for r in summary.collect():
            held, total = area(series[r["series"]], r["min_t"], r["max_t"])
            assert r["held_ms"] == held and r["area"] == pytest.approx(total) and r["n"] == len(series[r["series"]])
            assert r["mean"] == (pytest.approx(total / held) if held else None)
    built = pyr.build_pyramid(points, TIME_WEIGHTED, 4, 4, bits=10)
    for r in built.nodes.collect():
        held, total = area(series[r["series"]], r["min_t"], r["max_t"])
        assert r["held_ms"] == held and r["area"] == pytest.approx(total)
    assert pyr.validate_pyramid(built).collect() == []


def test_time_weighted_view_of_a_stored_pyramid(spark, frame):
    series = {"a": data(900), "b": data(200, 3)}
    path = new_folder(spark, "weighted")
    built = store_pyramid(frame(series), path, TIME_WEIGHTED, 8, 4)
    start, end = series["a"][100][0], series["a"][700][0]
    for width in (30, 300, 30_000):
        seen = view(built, Viewport(start, end, width, 10_000_000)).collect()
        assert sum(r["n"] for r in seen) > 0
        for r in seen:
            held, total = area(series[r["series"]], r["min_t"], r["max_t"])
            assert r["held_ms"] == held and r["area"] == pytest.approx(total)
    with pytest.raises(ValueError, match="holds a pyramid of kind"):
        read_pyramid(spark, path, ENDS)


def test_an_appended_pyramid_sees_the_gap(spark, frame):
    pairs = data(300)
    first = pyr.build_pyramid(frame({"a": pairs[:170]}), TIME_WEIGHTED, 8, 4)
    first = pyr.Pyramid(materialize(first.points, "p"), materialize(first.nodes, "n"), first.spec, first.shape)
    late = frame({"a": pairs[170:]}).withColumn("pos", F.col("t"))
    grown = pyr.append_points(first, late, "pos")
    once = pyr.build_pyramid(frame({"a": pairs}), TIME_WEIGHTED, 8, 4)

    def listed(df):
        return sorted((r["level"], r["node_id"], r["min_t"], r["max_t"], r["n"], r["held_ms"], round(r["area"], 3)) for r in df.collect())
    assert listed(grown.nodes) == listed(once.nodes)
    assert sorted(map(tuple, grown.points.select("t", "v", "next_t").collect()), key=str) == sorted(
        map(tuple, once.points.select("t", "v", "next_t").collect()), key=str)
    with pytest.raises(ValueError, match="looks at the next point"):
        pyr.append_time_points(pyr.build_time_pyramid(frame({"a": pairs}), TIME_WEIGHTED), frame({"a": pairs}))


def test_ends_and_trend(frame):
    pairs = data(500)
    kind = trend(pairs[0][0], 1000)
    built = pyr.build_pyramid(frame({"a": pairs}), kind, 8, 4)
    for r in kind.with_finals(built.nodes).collect():
        own = [((t - pairs[0][0]) / 1000, v) for t, v in pairs if r["min_t"] <= t <= r["max_t"]]
        mx, mv = (sum(x[i] for x in own) / len(own) for i in (0, 1))
        xx = sum((x - mx) ** 2 for x, _ in own)
        assert r["variance"] == pytest.approx(sum((v - mv) ** 2 for _, v in own) / len(own), rel=1e-6, abs=1e-9)
        assert r["slope"] == (pytest.approx(sum((x - mx) * (v - mv) for x, v in own) / xx, rel=1e-5, abs=1e-9) if xx else None)
    ends = rs.resample(rs.resample_points(frame({"a": pairs}), 1000, ENDS), 60_000, ENDS)
    for r in ENDS.with_finals(ends).collect():
        own = [v for t, v in pairs if r["min_t"] <= t <= r["max_t"]]
        assert (r["first_v"], r["last_v"], r["n"], r["change"]) == (own[0], own[-1], len(own), own[-1] - own[0])
    tumbled = rs.tumble(frame({"a": pairs}), 60_000, ENDS).collect()
    assert sum(r["n"] for r in tumbled) == 500 and all(r["t"] % 60_000 == 0 for r in tumbled)


def test_sketches_keep_their_bounds_through_a_pyramid(spark, frame):
    rnd = random.Random(3)
    pairs = [(i * 10, float(round(rnd.gauss(0, 400)))) for i in range(6000)]
    kind = sketches()
    built = store_pyramid(frame({"a": pairs}), new_folder(spark, "sketches"), kind, 64, 16)
    looked = lod.query_lod(built, 5000, 50_000, 12_000)
    tops = agg.series_summary(built)
    for r in [*kind.with_finals(looked).filter("n > 100").collect(), *tops.collect()]:
        own = sorted(v for t, v in pairs if r["min_t"] <= t <= r["max_t"])
        assert r["n"] == len(own)
        assert abs(r["n_distinct"] - len(set(own))) <= 0.04 * len(set(own))
        low, high = bisect_left(own, r["median"]) / len(own), bisect_right(own, r["median"]) / len(own)
        assert low - 0.02 <= 0.5 <= high + 0.02
    assert pyr.validate_pyramid(built).collect() == []
    seen = view(built, Viewport(0, 60_000, 96, 1000))
    assert sum(r["n"] for r in seen.collect()) >= 6000
    tenth = tops.select(quantile(F.col("ranks"), 0.1)).first()[0]
    assert abs(bisect_left(sorted(v for _, v in pairs), tenth) / 6000 - 0.1) < 0.03


def test_the_two_forms_do_not_mix():
    with pytest.raises(ValueError, match="needs either"):
        AggregateSpec("x")
    with pytest.raises(ValueError, match="needs either"):
        AggregateSpec("x", lift=lambda v: {"a": v}, merge={"a": F.sum}, from_points=lambda c: {})
    with pytest.raises(ValueError, match="looks ahead"):
        AggregateSpec("x", lift=lambda v: {"a": v}, merge={"a": F.sum}, ahead=("t",))
