"""Readers of several columns with state: the rows of a file are folded into the points of one series."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.fold import Fold, fold_scan, pa_types
from tidegrid.operators.scan import SLAB_BITS

Point = tuple[int, Any]


@dataclass(frozen=True)
class ColumnReader:
    """How some columns of a file become the series ``series`` with values of the type ``value``.

    ``step(state, t, cells)`` gives the next state, a tuple of the columns of the schema ``state``, and a point ``(t, v)`` or
    None; ``cells`` are the texts of ``columns`` in a row, None where there is none. ``finish`` gives the point that the state
    after a file's last row still holds. A file begins with ``initial``.
    """

    series: str
    columns: Sequence[str]
    value: str
    state: str
    initial: tuple
    step: Callable[[tuple, int, tuple], tuple[tuple, Point | None]]
    finish: Callable[[tuple], Point | None] | None = None


def epoch_ms(cell: str | None) -> int:
    """Seconds as milliseconds, truncated toward zero."""
    try:
        return int(float(cell) * 1000)
    except (TypeError, ValueError, OverflowError):
        raise ValueError(f"cannot read time: {cell}") from None


def read_columns(rows: DataFrame, header: Sequence[str], reader: ColumnReader, bits: int = SLAB_BITS) -> DataFrame:
    """The points ``series, t, v, file, pos`` that ``reader`` makes of ``rows``, as ``read_wide_csv`` gives them for ``header``.

    ``pos`` is the row a point was finished by, that of the file's last one for ``finish``. A file is folded by slabs of its
    rows, so also a large one is read by many tasks (see ``fold``). A time that cannot be read fails the query, and so does a
    column that the header lacks.
    """
    if missing := [c for c in reader.columns if c not in header[1:]]:
        raise ValueError(f"no column {missing} in the header")
    at = [header.index(c, 1) for c in reader.columns]
    used = [f"c{i}" for i in dict.fromkeys([0, *at])]
    cells = rows.select("file", "pos", *used)
    place = [used.index(f"c{i}") for i in at]

    def step(state: tuple, row: tuple) -> tuple[tuple, bool]:
        texts = tuple(row[i] or None for i in place)
        kept, point = reader.step(state[:-2], epoch_ms(row[0]), texts)
        return (*kept, *(point or (None, None))), False

    rule = Fold(used, f"{reader.state}, _t BIGINT, _v {reader.value}", (*reader.initial, None, None), step)
    folded = fold_scan(cells, ["file"], "pos", rule, "_group", bits)
    name = F.lit(reader.series).alias("series")
    points = folded.filter("_t IS NOT NULL").select(name, F.col("_t").alias("t"), F.col("_v").alias("v"), "file", "pos")
    if reader.finish is None:
        return points
    state = rule.schema.names[:-2]
    last = folded.groupBy("file").agg(F.max("pos").alias("pos"), F.max_by(F.struct(*state), "pos").alias("_s")).select(
        "file", "pos", "_s.*")  # a row for each file
    schema = T.StructType([T.StructField("t", T.LongType()), T.StructField("v", rule.schema["_v"].dataType),
                           T.StructField("file", T.StringType()), T.StructField("pos", T.LongType())])
    kinds, finish = pa_types(schema), reader.finish

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                point = finish(tuple(r[c] for c in state))
                if point is not None:
                    found.append((*point, r["file"], r["pos"]))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], schema.names)

    return points.unionByName(last.mapInArrow(held, schema).withColumn("series", name))
