"""Ranges of places inside rows, and which of many equal strings come first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.exchange import new_group, with_ids
from tidegrid.session import materialize

#: Places [lo, hi) of a row; ``open`` ones are still to be decided.
RANGES = "row_id long, lo int, hi int, open boolean"
RANGE_KINDS = (np.int64, np.int64, np.int64, bool)
STRING_KINDS = (np.uint64, np.uint32, np.int64, np.int32)
#: Strings of one batch that are sorted at once.
STRINGS = 1 << 19


def range_table(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, open_: np.ndarray) -> pa.Table:
    return pa.table({"row_id": pa.array(row, pa.int64()), "lo": pa.array(lo.astype(np.int32), pa.int32()),
                     "hi": pa.array(hi.astype(np.int32), pa.int32()), "open": pa.array(open_, pa.bool_())})


def first_strings(columns: list[np.ndarray], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Strings by two hashes (one, two, row, lo): the first of each by place, and ranges of what the later ones cover, joined.

    A string that is there twice at the same place, as repeated rows have it, is one.
    """
    one, two, row, lo = columns
    order = np.lexsort((lo, row, two, one))
    one, two, row, lo = one[order], two[order], row[order], lo[order]
    new = new_group(one, two)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(one) else np.zeros(0, np.int64)
    later = (row != row[first]) | (lo != lo[first])
    r, p = row[later], lo[later].astype(np.int64)
    order = np.lexsort((p, r))
    r, p = r[order], p[order]
    cut = new_group(r)
    cut[1:] |= np.diff(p) > 1
    begin = np.flatnonzero(cut)
    ends = p[np.append(begin[1:], len(p)) - 1] + length if len(begin) else p
    kept = np.flatnonzero(new)
    kept = kept[np.lexsort((lo[kept], row[kept]))]
    return [c[kept] for c in (one, two, row, lo)], [r[begin], p[begin], ends, np.zeros(len(begin), bool)]


def merged(spans: Iterable[tuple[int, int]], overlap: int = 0) -> list[tuple[int, int]]:
    """Spans that share at least ``overlap`` places, or touch for 0, made one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] - overlap:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def string_batches(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
    """Columns (one, two, row, lo) of strings, gathered to about STRINGS rows."""
    parts: list[tuple[np.ndarray, ...]] = []
    size = 0
    for columns in found:
        parts.append(columns)
        size += len(columns[0])
        if size >= STRINGS:
            yield _columns(parts)
            parts, size = [], 0
    if parts:
        yield _columns(parts)


def _columns(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    return [np.concatenate(c).astype(k) for c, k in zip(zip(*parts, strict=True), STRING_KINDS, strict=True)]


def spans_of(ranges: DataFrame) -> DataFrame:
    """``row_id, spans``: the ranges of each row in one list, which is shorter than the row's text."""
    return materialize(ranges.groupBy("row_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` with the list of their spans, null without one."""
    touched, others = with_ids(rows, spans.select("row_id"))
    if others is None:
        return rows.join(spans, "row_id", "left")
    joined = touched.join(spans, "row_id", "left")
    return joined.unionByName(others.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)))
