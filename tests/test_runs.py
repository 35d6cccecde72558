import pytest

from tidegrid.operators import lod, pyramid as pyr
from tidegrid.sources.manifest import read_manifest, vacuum, versions
from tidegrid.streaming import runs

SCHEMA = "series STRING, t BIGINT, v DOUBLE"
GRID = ("num", 10, 4, 3)


def batch(i, n=6):
    return [("s", i * 40 + j * 7, float(j)) for j in range(n)] + ([("b", i, 1.0)] if i % 3 == 0 else [])


def listed(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def same(got, rows, spark):
    want = pyr.build_time_pyramid(spark.createDataFrame(rows, SCHEMA), *GRID)
    assert listed(got.nodes, want.nodes.columns) == listed(want.nodes, want.nodes.columns)
    assert listed(got.points, ["series", "t", "v"]) == sorted(rows, key=str)


def test_runs_of_many_batches(spark, tmp_path):
    path, add, seen = f"{tmp_path}/out", runs.append_runs(f"{tmp_path}/out", *GRID), []
    with pytest.raises(ValueError, match="no batch"):
        runs.read_runs(spark, path)
    add(spark.createDataFrame([], SCHEMA), 0)
    for i in range(1, 9):
        rows = batch(i, 30 if i == 1 else 6)
        add(spark.createDataFrame(rows, SCHEMA), i)
        seen += rows
        assert len(read_manifest(spark, path).parts) <= 3
        if i in (2, 5):
            add(spark.createDataFrame(rows, SCHEMA), i)  # comes again
    same(runs.read_runs(spark, path), seen, spark)
    found = lod.query_lod(runs.read_runs(spark, path), 0, 400, 40).collect()
    assert sum(r["n"] for r in found if r["series"] == "s") >= len([r for r in seen if r[0] == "s" and r[1] < 400])
    with pytest.raises(ValueError, match="holds a pyramid of"):
        runs.append_runs(path, "num", 20, 4, 3)(spark.createDataFrame(batch(1), SCHEMA), 99)


def test_a_reader_keeps_its_version_while_runs_are_merged(spark, tmp_path):
    path, add = f"{tmp_path}/out", runs.append_runs(f"{tmp_path}/out", *GRID, merge=False)
    rows = []
    for i in range(4):
        add(spark.createDataFrame(batch(i), SCHEMA), i)
        rows += batch(i)
    held = runs.read_runs(spark, path)
    assert len(read_manifest(spark, path).parts) == 4
    assert runs.merge_runs(spark, path) == 1
    same(held, rows, spark)
    same(runs.read_runs(spark, path), rows, spark)
    same(runs.read_runs(spark, path, version=2), batch(0) + batch(1), spark)
    assert len(vacuum(spark, path)) == 4 and len(versions(spark, path)) == 1
    same(runs.read_runs(spark, path), rows, spark)
    assert runs.merge_runs(spark, path) == 1 and runs.merge_runs(spark, f"{tmp_path}/none") == 0


def test_streams_are_told_apart(spark, tmp_path):
    """A stream that begins anew has the same batch ids and brings other rows."""
    for k in range(2):
        for i in range(2):
            spark.createDataFrame(batch(2 * k + i), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in{k}/{i}")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in{k}/*")
        for _ in range(2):  # the second start finds nothing new
            (stream.writeStream.foreachBatch(runs.append_runs(f"{tmp_path}/out", *GRID))
             .option("checkpointLocation", f"{tmp_path}/cp{k}").trigger(availableNow=True).start().awaitTermination())
    same(runs.read_runs(spark, f"{tmp_path}/out"), [r for i in range(4) for r in batch(i)], spark)
    assert sorted(read_manifest(spark, f"{tmp_path}/out").batches.values()) == [1, 1]
