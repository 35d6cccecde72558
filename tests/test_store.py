import os

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import pyramid as pyr
from tidegrid.session import cleared, materialize, new_folder, shared_dir
from tidegrid.sources.store import read_points, read_pyramid, store_pyramid, write_points, write_pyramid
from tidegrid.sources.tables import as_series


def test_round_trip(spark, points, rows):
    df = points([(i, i * 2) for i in range(100)])
    path = new_folder(spark, "store")
    write_points(df, f"{path}/points", files=3)
    assert rows(read_points(spark, f"{path}/points")) == rows(df)
    built = pyr.build_pyramid(df, "num", 4, 4)
    write_pyramid(built, f"{path}/pyramid")
    back = read_pyramid(spark, f"{path}/pyramid")
    assert rows(back.nodes, *built.nodes.columns) == rows(built.nodes)
    assert rows(back.points, *built.points.columns) == rows(built.points)
    assert rows(pyr.validate_pyramid(back)) == []
    direct = store_pyramid(df, f"{path}/direct", "num", 4, 4)
    assert rows(direct.nodes, *built.nodes.columns) == rows(built.nodes)
    assert rows(direct.points, *built.points.columns) == rows(built.points)


def test_materialize_keeps_rows_and_schema(spark, points, rows):
    df = points([(1, 2), (3, 4)])
    kept = materialize(df, "t")
    assert kept.schema == df.schema and rows(kept) == rows(df)
    assert new_folder(spark, "t").startswith(shared_dir(spark))
    assert "FileScan parquet" in kept._jdf.queryExecution().executedPlan().toString()


def test_as_series(spark, rows):
    df = spark.sql("""SELECT * FROM VALUES ('a', TIMESTAMP_NTZ'2024-01-01 00:00:00.0019', 1.5D), (NULL, TIMESTAMP_NTZ'2024-01-01', 2D),
        ('b', NULL, 3D), ('c', TIMESTAMP_NTZ'2024-01-01', NULL), ('d', TIMESTAMP_NTZ'1969-12-31 23:59:59.9995', 4D) AS x(k, ts, v)""")
    assert rows(as_series(df, "k", "ts", "v")) == [("a", 1704067200001, 1.5), ("d", -1, 4.0)]
    assert rows(as_series(df, "k", "ts", "v", between=(1704067200001, 1704067200001)), "series") == [("a",)]
    assert rows(as_series(df, "k", "ts", "v", between=(-5, 1704067200000)), "series") == [("d",)]
    zoned = df.withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(as_series(zoned, "k", "ts", "v", between=(-5, -1)), "series") == [("d",)]
    ints = spark.createDataFrame([(7, 5, 1.0)], "k INT, t INT, v DOUBLE")
    assert rows(as_series(ints, "k", "t", "v", between=(5, 5))) == [("7", 5, 1.0)]


def test_as_series_in_another_session_zone(spark, rows):
    df = spark.sql("SELECT 'a' AS k, TIMESTAMP_NTZ'2024-07-01 12:00:00' AS ts, 1D AS v")
    spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
    try:
        assert rows(as_series(df, "k", "ts", "v"), "t") == [(1719835200000,)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_shape_and_kind_are_stored(spark, tmp_path, points):
    path = f"{tmp_path}/shaped"
    store_pyramid(points([(i, i) for i in range(50)]), path, "num", 8, 4)
    assert read_pyramid(spark, path).shape == pyr.CountShape(8, 4)
    with pytest.raises(ValueError, match="kind num"):
        read_pyramid(spark, path, "str")
    with pytest.raises(ValueError, match="holds a pyramid"):
        store_pyramid(points([(1, 1)]), path, "num", 4, 4)


def test_written_folders_are_cleared(spark, points):
    with cleared(spark):
        kept = materialize(points([(1, 1)]), "scratch")
        files = kept.inputFiles()
        assert kept.count() == 1 and all(os.path.exists(f.removeprefix("file://")) for f in files)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
