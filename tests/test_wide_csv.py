import random

import pytest
from pyspark.sql import functions as F

from tidegrid.model import KINDS, AggregateSpec, register_kind
from tidegrid.sources import wide_csv as wc


@pytest.fixture
def write(tmp_path):
    def make(text, name="a.csv"):
        path = tmp_path / name
        path.write_text(text if text.endswith("\n") else "\n".join(text.split()) + "\n")
        return str(path)
    return make


def load(spark, *paths, **kw):
    return wc.load_all(spark, paths, **kw)


def test_numbers_text_and_empty_column(spark, write, rows):
    got = load(spark, write("time,speed,state,unused 1.0,10,idle, 1.5,,run, 2.0,12.5,run,"))
    assert rows(got.points("num")) == [("speed", 1000, 10.0), ("speed", 2000, 12.5)]
    assert rows(got.points("str")) == [("state", 1000, "idle"), ("state", 1500, "run"), ("state", 2000, "run")]
    assert got.points("arr") is None
    assert rows(got.catalog) == [("speed", "num", 2, 2, 1000, 2000), ("state", "str", 3, 3, 1000, 2000)]


def test_time_is_truncated_toward_zero(spark, write, rows):
    got = load(spark, write("time,x -1.2349,1 1.2349,2"))
    assert rows(got.points("num"), "t") == [(-1234,), (1234,)]


def test_array_groups(spark, write, rows):
    got = load(spark, write("time,c0,c1,c2,c3 1,1,2,3,4 2,5,6,7,8"))
    assert got.points("num") is None
    assert rows(got.points("arr")) == [("c", 1000, [1.0, 2.0, 3.0, 4.0]), ("c", 2000, [5.0, 6.0, 7.0, 8.0])]  # the last row stays
    few = load(spark, write("time,c0,c1,c2 1,1,2,3", "few.csv"))
    assert rows(few.points("num"), "series") == [("c0",), ("c1",), ("c2",)]
    text = load(spark, write("time,c0,c1,c2,c3 1,1,2,3,x", "text.csv"))
    assert rows(text.points("num"), "series") == [("c0",), ("c1",), ("c2",)]
    assert rows(text.points("str")) == [("c3", 1000, "x")]
    bare = load(spark, write("time,v,v1,v2,v3 1,1,2,3,4", "bare.csv"))
    assert rows(bare.points("num"), "series") == [("v",), ("v1",), ("v2",), ("v3",)]
    five = load(spark, write("time,w,v4,v2,v3,v1 1,0,4,2,3,1", "five.csv"))  # any start, index order
    assert rows(five.points("arr")) == [("v", 1000, [1.0, 2.0, 3.0, 4.0])] and rows(five.points("num")) == [("w", 1000, 0.0)]
    same = load(spark, write("time,v,v4,v2,v3,v1 1,0,4,2,3,1", "same.csv"))  # two series of one name: the later one
    assert rows(same.catalog, "series", "kind") == [("v", "arr")]


def test_incomplete_arrays(spark, write, rows):
    got = load(spark, write("time,c0,c1,c2,c3 1,1,2,3,4 2,5,6,,8 3,,,, 4,1,1,1,1"))
    assert rows(got.points("arr"), "t") == [(1000,), (4000,)]
    never_full = load(spark, write("time,c0,c1,c2,c3 1,1,2,,4 2,5,6,,8 3,9,,,", "n.csv"), sample_rows=None)
    # c2 holds nothing, so there is no group of four
    assert never_full.points("arr") is None
    short = load(spark, write("time,c0,c1,c2,c3 1,1,2,,4 2,5,6,,8 3,9,,7,", "s.csv"))
    assert rows(short.points("arr"), "t", "v") == [(1000, [1.0, 2.0]), (2000, [5.0, 6.0])]


def test_rows_of_one_time_fill_the_array_together(spark, write, rows):
    got = load(spark, write("time,c0,c1,c2,c3 1,1,2,, 1,9,9,3,4 2,5,6,7,8"))
    assert rows(got.points("arr"), "t", "v") == [(1000, [1.0, 2.0, 3.0, 4.0]), (2000, [5.0, 6.0, 7.0, 8.0])]


def test_backward_times(spark, write, rows):
    got = load(spark, write("time,x 1,1 3,2 2,3 3,4 4,5"))
    assert rows(got.points("num"), "t", "v") == [(1000, 1.0), (3000, 2.0), (4000, 5.0)]
    assert rows(got.catalog) == [("x", "num", 5, 3, 1000, 4000)]
    arrays = write("time,c0,c1,c2,c3 1,1,1,1,1 3,1,1,1,1 2,1,1,1,1", "back.csv")
    with pytest.raises(Exception, match="jumped back in time"):
        load(spark, arrays)
    assert rows(load(spark, arrays, strict=False).points("arr"), "t") == [(1000,), (3000,)]


def test_kinds_come_from_the_first_rows(spark, write, rows):
    late = write("time,x " + " ".join(f"{i},{i}" for i in range(16)) + " 16,abc", "late.csv")
    with pytest.raises(Exception, match="cannot read num: abc"):
        load(spark, late)
    assert load(spark, late, strict=False).points("num").count() == 16
    assert rows(load(spark, late, sample_rows=None).catalog, "kind", "n_points") == [("str", 17)]
    lost = write("time,x,y " + " ".join(f"{i},1," for i in range(16)) + " 16,1,5", "lost.csv")
    assert rows(load(spark, lost).catalog, "series") == [("x",)]
    assert rows(load(spark, lost, sample_rows=None).catalog, "series", "n_points") == [("x", 17), ("y", 1)]


def test_numbers_as_the_parser_reads_them(spark, write, rows):
    got = load(spark, write("time,x\n1,1f\n2, 1 \n3,NaN\n4,.5\n5,5.\n6,-1e3\n"))
    values = [r[1] for r in rows(got.points("num"), "t", "v")]
    assert values[:2] == [1.0, 1.0] and values[2] != values[2] and values[3:] == [0.5, 5.0, -1000.0]


def test_quotes_ragged_rows_and_equal_names(spark, write, rows):
    got = load(spark, write('time,a,a,b\n1,1,x,"he said ""hi"", twice"\n2,2,y\n3,3,z,w,extra\n'))
    assert rows(got.points("str")) == [("a", 1000, "x"), ("a", 2000, "y"), ("a", 3000, "z"),
                                       ("b", 1000, 'he said "hi", twice'), ("b", 3000, "w")]
    assert got.points("num") is None  # of two columns with one name the last counts
    lines = load(spark, write('time,a\n1,"two\nlines"\n2,one\n', "m.csv"), multi_line=True)
    assert rows(lines.points("str"), "v") == [("one",), ("two\nlines",)]


def test_later_file_replaces_a_series(spark, write, rows):
    first = write("time,x,y 1,1,1 2,2,2", "one.csv")
    second = write("time,x 5,9 6,8", "two.csv")
    got = load(spark, first, second)
    assert rows(got.points("num")) == [("x", 5000, 9.0), ("x", 6000, 8.0), ("y", 1000, 1.0), ("y", 2000, 2.0)]
    assert rows(got.catalog, "series", "n_points") == [("x", 2), ("y", 2)]
    kinds = load(spark, first, write("time,x 5,text", "three.csv"))
    assert rows(kinds.catalog, "series", "kind") == [("x", "str"), ("y", "num")]
    with pytest.raises(ValueError, match="not a .csv"):
        load(spark, first, "notes.txt")


def test_file_without_rows(spark, write, rows):
    assert rows(load(spark, write("time,x\n")).catalog) == []


def test_order_of_a_file_read_in_many_splits(spark, tmp_path, rows):
    """Backward points are found across split borders."""
    rnd, last, kept, lines = random.Random(1), -100, [], ["time,x"]
    for i in range(20_000):
        t = i + rnd.randint(-30, 30)
        lines.append(f"{t},{i}")
        if t > last:
            kept.append((t * 1000, float(i)))
            last = t
    path = tmp_path / "long.csv"
    path.write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        read = wc.read_wide_csv(spark, str(path), ("time", "x"))
        assert read.rdd.getNumPartitions() > 5
        assert [r["c1"] for r in read.orderBy("pos").select("c1").collect()] == [str(i) for i in range(20_000)]
        got = load(spark, str(path))
        assert rows(got.points("num"), "t", "v") == kept
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_folder_of_part_files_keeps_every_point(spark, tmp_path, rows):
    folder = tmp_path / "parts.csv"
    folder.mkdir()
    for k in range(2):
        (folder / f"part-{k}.csv").write_text("time,x\n" + "".join(f"{100 * k + i},{i}\n" for i in range(100)))
    got = load(spark, str(folder))
    assert rows(got.catalog, "n_submitted", "n_points") == [(200, 200)]
    (folder / "part-2.csv").write_text("x,time\n1,2\n")
    with pytest.raises(ValueError, match="other columns"):
        load(spark, str(folder))


def test_jobs_do_not_grow_with_the_files(spark, write, rows):
    tracker = spark.sparkContext.statusTracker()

    def jobs(n):
        paths = [write(f"time,x{i} 1,{i} 2,{i}", f"n{n}-{i}.csv") for i in range(n)]
        same = [write("time,x,y 1,1,2 2,3,4", f"same{n}-{i}.csv") for i in range(n)]
        spark.sparkContext.setJobGroup(f"load-{n}", "")
        got = load(spark, *same)
        assert rows(got.points("num"), "series", "t") == [("x", 1000), ("x", 2000), ("y", 1000), ("y", 2000)]
        return len(tracker.getJobIdsForGroup(f"load-{n}")), paths
    few, many = jobs(2)[0], jobs(7)[0]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert many <= few


def test_sample_reads_the_head_only(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("time,x,s\n" + "1,2,a\n" * 200_000)
    head = wc.read_head(spark, str(path), 17, first_bytes=64)
    assert len(head) == 17 and head[:2] == [["time", "x", "s"], ["1", "2", "a"]]
    quoted = tmp_path / "quoted.csv"
    quoted.write_text('time,"a ""b"", c"\n1,"x\ny"\n')
    assert wc.read_head(spark, str(quoted), 17, first_bytes=4) == [["time", 'a "b", c'], ["1", "x\ny"]]


def test_unreadable_cells_fail_under_a_count_too(spark, write):
    layout = wc.Layout(("time", "x"), ("num",))
    for text in ("time,x 1,2 2,no", "time,x 1,2 soon,3"):
        read = wc.read_wide_csv(spark, write(text), layout.header)
        with pytest.raises(Exception, match="cannot read"):
            wc.melt_numeric(read, layout).count()


def test_user_kind_reads_a_column(spark, write, rows):
    flag = AggregateSpec("flag", lambda v: {"n": F.lit(1).cast("long"), "on": v}, {"n": F.sum, "on": F.max},
                         parse=lambda c: F.when(c == "on", 1).when(c == "off", 0))
    register_kind(flag)
    try:
        got = load(spark, write("time,s,x 1,on,5 2,off,6"), kinds={"s": "flag"})
        assert rows(got.points("flag")) == [("s", 1000, 1), ("s", 2000, 0)]
        assert rows(got.catalog, "series", "kind") == [("s", "flag"), ("x", "num")]
    finally:
        KINDS.pop("flag")


def test_headers():
    layout = wc.Layout(("time", "a0", "a1", "a2", "a3", "a1", "b"), ("num",) * 5 + (None,))
    assert layout.arrays == {"a": [1, 2, 3, 4]} and layout.columns("num") == {}
    assert layout.series() == {"a": "arr"}
    numbered = wc.Layout(("time", "0", "1", "2", "3"), ("num",) * 4)
    assert numbered.arrays == {"": [1, 2, 3, 4]}
