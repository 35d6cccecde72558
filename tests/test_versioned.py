import os
import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import pyramid as pyr
from tidegrid.operators.kinds import TIME_WEIGHTED
from tidegrid.plans.view import Viewport, view
from tidegrid.session import new_folder
from tidegrid.sources import versioned as ver
from tidegrid.sources.manifest import Conflict, Manifest, Part, commit, read_manifest, to_merge, vacuum, versions


def data(n, seed=1, begin=0):
    rnd, t, out = random.Random(seed), begin, []
    for _ in range(n):
        t += rnd.choice([1, 3, 50])
        out.append((t, float(rnd.randrange(100))))
    return out


@pytest.fixture
def frame(spark):
    def make(series):
        rows = [(s, t, v) for s, pairs in series.items() for t, v in pairs]
        return spark.createDataFrame(rows, "series STRING, t BIGINT, v DOUBLE").withColumn("pos", F.col("t"))
    return make


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


NODE = ["series", "level", "node_id", "min_t", "max_t", "n", "parent_id", "parent_span", "n_points"]


def same(got, want, state=("lo", "hi", "total")):
    assert listed(got.nodes, *NODE, *state) == listed(want.nodes, *NODE, *state)
    columns = [c for c in want.points.columns if c != "series_n"]
    assert listed(got.points, *columns) == listed(want.points, *columns)


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path.removeprefix("file:")) for f in files)


def test_appends_equal_a_rebuild(spark, frame):
    series = {"a": data(260), "b": data(90, 2), "late": data(40, 3, 4000)}
    cut = {"a": [120, 121, 200], "b": [90, 90, 90], "late": [0, 0, 25]}  # b does not grow, late begins late
    path = new_folder(spark, "versions")
    first = ver.create_stored(frame({s: p[:cut[s][0]] for s, p in series.items()}).drop("pos"), path, leaf_size=4, fanout=4)
    assert first.nodes.count() > 0
    for i in range(3):
        upto = {s: cut[s][i + 1] if i < 2 else len(p) for s, p in series.items()}
        # what arrives overlaps what is held
        got = ver.append_stored(frame({s: p[max(0, cut[s][i] - 5):upto[s]] for s, p in series.items()}), path, "pos")
        want = pyr.build_pyramid(frame({s: p[:upto[s]] for s, p in series.items()}).drop("pos"), "num", 4, 4)
        same(got, want)
    assert versions(spark, path) == [1, 2, 3, 4]
    port = Viewport(0, 6000, 300, 40)
    columns = ["series", "is_leaf", "min_t", "max_t", "lo", "hi", "n", "section_id"]
    assert listed(view(got, port), *columns) == listed(view(want, port), *columns)
    old = ver.read_stored(spark, path, version=2)
    same(old, pyr.build_pyramid(frame({s: p[:cut[s][1]] for s, p in series.items()}).drop("pos"), "num", 4, 4))
    assert ver.append_stored(frame({"a": series["a"][:9]}), path, "pos").points.count() == 390  # nothing is later
    assert versions(spark, path) == [1, 2, 3, 4]


def test_an_append_writes_what_it_changes(spark, frame):
    pairs = data(30_000)
    path = new_folder(spark, "versions")
    ver.create_stored(frame({"a": pairs[:29_000]}).drop("pos"), path, leaf_size=16, fanout=8)
    whole = size(path)
    ver.append_stored(frame({"a": pairs[29_000:29_050]}), path, "pos")
    assert size(path) - whole < 0.2 * whole  # mostly the files' own heads
    ver.append_stored(frame({"a": pairs[29_050:29_060]}), path, "pos")
    rows = [p.rows for p in read_manifest(spark, path).parts]
    assert rows[0] == 29_000 and rows[1] <= 50 + 16 and rows[2] <= 10 + 16


def test_a_failed_or_slower_append_leaves_what_was_there(spark, frame, monkeypatch):
    path = new_folder(spark, "versions")
    pairs = data(60)
    ver.create_stored(frame({"a": pairs[:40]}).drop("pos"), path, leaf_size=4, fanout=4)
    later = frame({"a": pairs[40:]})
    with monkeypatch.context() as broken:
        broken.setattr(ver, "_write_cuts", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ver.append_stored(later, path, "pos")
    assert versions(spark, path) == [1] and ver.read_stored(spark, path).points.count() == 40
    with monkeypatch.context() as slow:  # another writer commits between this one's read and its commit
        write = ver._write_cuts

        def overtaken(*args):
            write(*args)
            slow.setattr(ver, "_write_cuts", write)
            ver.append_stored(later, path, "pos")
        slow.setattr(ver, "_write_cuts", overtaken)
        with pytest.raises(Conflict):
            ver.append_stored(later, path, "pos")
    assert versions(spark, path) == [1, 2] and ver.read_stored(spark, path).points.count() == 60
    assert len(vacuum(spark, path)) == 2  # of the two failed ones; version 2 names both good parts
    assert versions(spark, path) == [2] and ver.read_stored(spark, path).points.count() == 60


def test_compaction_keeps_parts_few_and_versions_apart(spark, frame):
    pairs = data(400)
    path = new_folder(spark, "versions")
    ver.create_stored(frame({"a": pairs[:150], "b": pairs[:9]}).drop("pos"), path, "num", 4, 4)
    for at in range(150, 186, 12):
        before = ver.read_stored(spark, path)
        ver.append_stored(frame({"a": pairs[at:at + 12]}), path, "pos")
        held = ver.read_stored(spark, path)
        count = ver.compact_stored(spark, path)
        assert count <= 4
    want = pyr.build_pyramid(frame({"a": pairs[:186], "b": pairs[:9]}).drop("pos"), "num", 4, 4)
    same(ver.read_stored(spark, path), want)
    same(held, want)  # planned before the compaction: its files are still there
    assert before.points.count() == 174 + 9
    assert vacuum(spark, path, keep=1)
    same(ver.read_stored(spark, path), want)


def test_a_kind_that_looks_ahead(spark, frame):
    pairs = data(100)
    path = new_folder(spark, "versions")
    ver.create_stored(frame({"a": pairs[:64]}).drop("pos"), path, TIME_WEIGHTED, 8, 4)
    got = ver.append_stored(frame({"a": pairs[64:]}), path, "pos", TIME_WEIGHTED)
    same(got, pyr.build_pyramid(frame({"a": pairs}).drop("pos"), TIME_WEIGHTED, 8, 4), ("held_ms", "area"))
    with pytest.raises(ValueError, match="a pyramid of kind"):
        ver.read_stored(spark, path, "num")


def test_sizes_stay_steep():
    parts, written = [], 0
    for i in range(1000):
        parts.append(Part(str(i), 10))
        begin = to_merge(parts)
        if begin is not None:
            written += sum(p.rows for p in parts[begin:])
            parts = [*parts[:begin], Part(str(i), sum(p.rows for p in parts[begin:]))]
        assert len(parts) <= 11 and sum(p.rows for p in parts) == 10 * (i + 1)
    assert written < 10_000 * 12


def test_manifests(spark):
    path = new_folder(spark, "manifest")
    assert read_manifest(spark, path) is None and versions(spark, path) == []
    with pytest.raises(ValueError, match="no stored pyramid"):
        ver.read_stored(spark, path)
    one = Manifest(0, "num", pyr.GridShape(5, 4, 3)).with_part("x", 7, batches={"q": 4})
    commit(spark, path, one)
    assert read_manifest(spark, path) == one and one.version == 1
    with pytest.raises(Conflict):
        commit(spark, path, one)
    assert read_manifest(spark, path, 1).shape == pyr.GridShape(5, 4, 3)
