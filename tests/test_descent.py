import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import descent, pyramid as pyr
from tidegrid.operators.descent import nearest_points
from tidegrid.session import new_folder
from tidegrid.sources.store import store_pyramid, write_points
from tidegrid.sources.versioned import append_stored, create_stored


def plain(times, t, tolerance):
    """Nearest by the rules of a lookup in sorted intervals: contained, else the closer, else the later one."""
    if t in times:
        return "contained", 0, t
    before = max((x for x in times if x < t and t - x <= tolerance), default=None)
    after = min((x for x in times if x > t and x - t <= tolerance), default=None)
    if before is not None and (after is None or t - before < after - t):
        return "before", t - before, before
    return None if after is None else ("after", after - t, after)


@pytest.fixture
def frame(spark):
    def make(series):
        rows = [(s, t, float(t % 7)) for s, times in series.items() for t in times]
        return spark.createDataFrame(rows, "series STRING, t BIGINT, v DOUBLE").withColumn("pos", F.col("t"))
    return make


def test_descent_equals_a_search(spark, frame):
    rnd = random.Random(2)
    series = {"a": sorted(rnd.sample(range(0, 3000), 400)), "b": sorted(rnd.sample(range(1000, 1100), 9)), "one": [50]}
    probes = [(s, t, i) for i, s in enumerate(("a", "b", "one", "none")) for t in (-900, 0, 49, 50, 51, 1500, 1049, 2999, 9000)]
    probes += [("a", rnd.randrange(-50, 3050), 9) for _ in range(60)] + [("a", 1500, 7)]
    df = spark.createDataFrame(probes, "series STRING, t BIGINT, id INT")
    path = new_folder(spark, "versions")
    create_stored(frame({s: x[:300] for s, x in series.items()}).drop("pos"), path, leaf_size=4, fanout=4)
    grown = append_stored(frame(series), path, "pos")
    for pyramid in (store_pyramid(frame(series).drop("pos"), new_folder(spark, "p"), leaf_size=4, fanout=4), grown):
        for tolerance in (0, 7, 10_000):
            got = sorted(map(tuple, nearest_points(pyramid, df, tolerance).collect()))
            want = [(s, t, i, *near, float(near[2] % 7)) for s, t, i in probes if (near := plain(series.get(s, []), t, tolerance))]
            assert got == sorted(want)


def test_limits(spark, frame):
    built = pyr.build_pyramid(frame({"a": range(10)}).drop("pos"), "num", 4, 4)
    none = spark.createDataFrame([], "series STRING, t BIGINT")
    assert nearest_points(built, none, 5).collect() == []
    many = spark.range(descent.FEW_PROBES + 1).select(F.lit("a").alias("series"), F.col("id").alias("t"))
    with pytest.raises(ValueError, match="use nearest_value"):
        nearest_points(built, many, 5)
    with pytest.raises(ValueError, match="count-based"):
        nearest_points(pyr.build_time_pyramid(frame({"a": range(10)}).drop("pos")), none, 5)


def scanned(df):
    """Rows that come out of the scans of a plan, after row groups have been skipped."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    metrics = [leaves.apply(i).metrics().get("numOutputRows") for i in range(leaves.size())]
    return sum(m.get().value() for m in metrics if m.isDefined())


def test_what_is_read_does_not_follow_the_points(spark, frame, monkeypatch):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = {}
        for n in (4_000, 32_000):
            path = new_folder(spark, "p")
            built = store_pyramid(frame({"a": range(0, 3 * n, 3)}).drop("pos"), path)
            write_points(built.points.cache(), f"{path}/small", files=n // 500)  # as many rows in each file at either size
            built = pyr.Pyramid(spark.read.parquet(f"{path}/small"), built.nodes, built.spec, built.shape)
            seen = []
            collect = descent._collected
            monkeypatch.setattr(descent, "_collected", lambda df: (seen.append(df), collect(df))[1])
            probes = spark.createDataFrame([("a", t) for t in range(n, n + 1000, 100)], "series STRING, t BIGINT")
            found = nearest_points(built, probes, 100)
            assert found.count() == 10
            monkeypatch.setattr(descent, "_collected", collect)
            kept = sum(len(df.collect()) for df in seen[1:])
            points = built.points.filter(F.col("t").between(n - 200, n + 1200))
            read[n] = kept, scanned(found), points.count()
        (few, low, _), (many, high, _) = read[4_000], read[32_000]
        assert high <= low + 2_000 and many <= few + 2 * 16 * 10
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.files.openCostInBytes")
