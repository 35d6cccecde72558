"""The order guard as a keyed stream: the last time of each series is state of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegrid.operators.scan import ordered
from tidegrid.session import share_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of streams that start from now on in RocksDB, on disk, with changes alone written to the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def guard_stream(points: DataFrame, pos: str, expire_ms: int | None = None) -> DataFrame:
    """The streamed points that move their series forward in time, in ``pos`` order inside each batch.

    A batch reads and writes the state of the series it holds and of no others. With ``expire_ms`` a series that nothing has
    come for so long (by the clock) is forgotten, and begins anew; batches without data then go on, so a trigger that ends by
    itself does not. The points of one series in one batch meet in one task;
    where a series may fill a batch use ``ingest.guard_batches``, which splits it.
    """
    share_package(points.sparkSession)
    names = points.columns
    forget = expire_ms is not None

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True).sort_values(pos, kind="stable")
        t = rows["t"].to_numpy(np.int64)
        high = np.maximum.accumulate(t)
        ahead = np.ones(len(t), bool)
        ahead[1:] = t[1:] > high[:-1]
        if last is not None:
            ahead &= t > last
        state.update((int(high[-1]) if last is None else max(int(high[-1]), last),))
        if forget:
            state.setTimeoutDuration(expire_ms)
        yield rows[ahead][names]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout
    whole = ordered(points, ["series", "t"], pos)
    return whole.groupBy("series").applyInPandasWithState(keep, points.schema, "last_t BIGINT", "append", timeout)
