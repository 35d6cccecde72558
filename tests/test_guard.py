import time

import pytest

from tidegrid.operators import points as pts
from tidegrid.streaming.guard import ROCKSDB, guard_stream, use_rocksdb

SCHEMA = "series STRING, t BIGINT, v DOUBLE, pos BIGINT"
BATCHES = [[("a", 5, 1.0, 1), ("a", 3, 2.0, 0), ("b", 5, 1.0, 2), *((f"s{i}", 1, 0.5, 10 + i) for i in range(20))],
           [("a", 2, 3.0, 30), ("a", 9, 4.0, 31), ("b", 5, 2.0, 32), ("a", 8, 9.0, 33), ("a", 10, 9.0, 34)],
           [("b", 6, 3.0, 40), ("c", 0, 1.0, 41), ("a", 10, 5.0, 42), ("a", 11, 6.0, 43), ("c", -5, 1.0, 44)]]


@pytest.fixture
def rocksdb(spark):
    names = ["spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"]
    before = {n: spark.conf.get(n, None) for n in names}
    use_rocksdb(spark)
    assert spark.conf.get(names[0]) == ROCKSDB
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def run(spark, path, last, **kwargs):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/[0-{last - 1}]")
    query = (guard_stream(stream, "pos", **kwargs).writeStream.format("parquet").option("path", f"{path}/out")
             .option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start())
    query.awaitTermination()
    return [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]


def written(spark, path, batches=BATCHES):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/in/{i}")
    return spark.createDataFrame([r for b in batches for r in b], SCHEMA)


def test_the_guard_goes_on_after_a_restart(spark, tmp_path, rows, rocksdb):
    whole = written(spark, tmp_path)
    first = run(spark, tmp_path, 2)
    second = run(spark, tmp_path, 3)  # from the checkpoint
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(pts.drop_backward(whole, "pos"))
    touched = [s["numRowsUpdated"] for s in [*first, *second]]
    assert touched == [22, 2, 3]  # the series of each batch
    assert second[-1]["numRowsTotal"] == 23


def test_a_silent_series_is_forgotten(spark, tmp_path, rows):
    written(spark, tmp_path, [[("a", 100, 1.0, 0), ("b", 3, 1.0, 1)]])
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
    query = (guard_stream(stream, "pos", expire_ms=1).writeStream.format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/cp").start())
    try:
        def wait(what):
            until = time.monotonic() + 60
            while not what([p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]):
                assert time.monotonic() < until and query.isActive
                time.sleep(0.1)
        wait(lambda ops: sum(o["numRowsRemoved"] for o in ops) == 2)  # what has come is forgotten by a later batch
        spark.createDataFrame([("a", 7, 1.0, 2)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/1")
        wait(lambda ops: sum(o["numRowsUpdated"] for o in ops) == 3)
    finally:
        query.stop()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "series", "t") == [("a", 7), ("a", 100), ("b", 3)]
