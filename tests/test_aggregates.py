import pytest
from pyspark.sql import functions as F

from tidegrid.model import AggregateSpec, KINDS, lift_points, register_kind
from tidegrid.operators import aggregates as agg
from tidegrid.operators.resample import resample_points


@pytest.mark.parametrize("values, n, summary", [
    (["up"] * 3, 3, "up"), (list("xyz"), 3, None), (["down", "up", "up"], 3, None), ([""], 1, "")])
def test_string_points(points, rows, values, n, summary):
    df = points(list(enumerate(values)), "STRING")
    assert rows(agg.agg_points(df, "str"), "n", "summary") == [(n, summary)]


@pytest.mark.parametrize("second, summary", [
    (["up"] * 4, "up"), (["down"] * 4, None), (["up", "down", "up", "up"], None)])
def test_string_merge(points, rows, second, summary):
    df = points(list(enumerate(["up"] * 4 + second)), "STRING")
    nodes = resample_points(df, 4, "str")
    assert nodes.count() == 2
    assert rows(agg.agg_nodes(nodes, "str"), "n", "summary") == [(8, summary)]


def test_array_counts_elements(points, rows):
    df = points([(0, [1.0, 2.0]), (1, [3.0, -4.0])], "ARRAY<DOUBLE>")
    assert rows(agg.agg_points(df, "arr"), "lo", "hi", "n", "total") == [(-4.0, 3.0, 4, 2.0)]
    assert rows(agg.series_summary(df, "arr"), "min_t", "max_t", "mean") == [(0, 1, 0.5)]


def test_limits_and_extent(spark, rows):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, -1.0), ("b", 7, 9.0), ("c", 0, 99.0)],
                               "series STRING, t BIGINT, v DOUBLE")
    assert rows(agg.value_limits(df, ["a", "b"])) == [(-1.0, 9.0)]
    assert rows(agg.value_limits(df)) == [(-1.0, 99.0)]
    assert rows(agg.time_extent(df)) == [("a", 1, 2), ("b", 7, 7), ("c", 0, 0)]
    assert rows(agg.with_mean(agg.agg_points(df, "num")), "series", "mean") == [("a", 2.0), ("b", 9.0), ("c", 99.0)]


def test_nan_is_largest(points):
    got = agg.agg_points(points([(0, 1.0), (1, float("nan")), (2, -1.0)]), "num").first()
    assert got["lo"] == -1.0 and got["hi"] != got["hi"] and got["n"] == 3


def test_user_kind(points, rows):
    spec = register_kind(AggregateSpec("product", lift=lambda v: {"n": F.lit(1).cast("long"), "p": v},
                                       merge={"n": F.sum, "p": F.product}))
    try:
        df = points([(0, 2), (1, 3), (9, 4)])
        assert rows(resample_points(df, 5, "product"), "min_t", "n", "p") == [(0, 2, 6.0), (9, 1, 4.0)]
        assert rows(agg.agg_points(df, spec), "n", "p") == [(3, 24.0)]
    finally:
        del KINDS["product"]
    with pytest.raises(ValueError):
        register_kind(AggregateSpec("bad", lift=lambda v: {"a": v}, merge={"b": F.sum}))


def test_lifted_points(points, rows):
    assert rows(lift_points(points([(3, 4)]), "num")) == [("s", True, 3, 3, 4.0, 4.0, 1, 4.0)]
