"""Repeated windows of words, prefiltered by a count-min sketch.

Every window of ``WINDOW`` words has an anchor, the run of ``ANCHOR`` words inside it whose hash is smallest; equal windows
have equal anchors. The first pass counts anchors in a count-min sketch of two rows of counters: its slices are dealt to
tasks by hash, each gets what every batch has counted for it, and the smaller counter of the two is at least the number of
times any window of that anchor is there. So a window of an anchor estimated once is unique, and no repeated window is lost.
The sketch grows with the corpus by its number of slices; nothing is broadcast. The second pass reads the documents that have
windows left and groups exactly those, by two independent hashes of all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm.arrays import U, Words, blocks, held, mix, run_hashes, text_bytes, window_minima
from tidegrid.llm.exchange import (PACKS, bucket_count, bucket_of, identified, new_group, pack, packed_batch, tagged,
                                   unpack_tagged, with_ids)
from tidegrid.llm.ranges import (RANGE_KINDS, RANGES, STRING_KINDS, first_strings, merged, range_table, spans_of,
                                 string_batches, with_spans)
from tidegrid.llm.workers import map_batches, map_groups

WINDOW, ANCHOR = 20, 10
#: Words worked on together; a place in them has PLACE bits.
PIECE, PLACE = 1 << 19, 20
#: Counters in each of the two rows of a slice of the sketch.
CELLS = 1 << 20
_KINDS = (np.uint64, np.int64, np.int32, np.uint8, np.uint8)


def anchors(column: pa.Array, row_id: np.ndarray) -> list[np.ndarray]:
    """Anchors of a column of texts: hash, row_id, first window, windows - 1, and how often it counts (1)."""
    out: list[list[np.ndarray]] = [[] for _ in _KINDS]
    for first, data, offsets in blocks(column):
        words = Words(data, offsets)
        h = words.hashes()
        for base in range(0, len(h), PIECE):
            end = min(len(h), base + PIECE + WINDOW - 1)
            if end - base < WINDOW:
                continue
            run = run_hashes(h[base:end], ANCHOR)
            place = U((1 << PLACE) - 1) - np.arange(end - base, dtype=U)
            low = window_minima((run >> U(PLACE) << U(PLACE)) | place, WINDOW - ANCHOR + 1)[:end - base - WINDOW + 1]
            row = words.row[base:end]
            p = np.flatnonzero(row[:len(low)] == row[WINDOW - 1:])
            if not len(p):
                continue
            a = ((1 << PLACE) - 1) - (low[p] & U((1 << PLACE) - 1)).astype(np.int64)
            new = new_group(a)
            new[1:] |= np.diff(p) != 1
            begin = np.flatnonzero(new)
            lo, hi = p[begin], p[np.append(begin[1:], len(p)) - 1]
            own = row[lo]
            for part, values in zip(out, (run[a[begin]], row_id[first + own], lo + base - words.begin[own], hi - lo,
                                          np.ones(len(lo))), strict=True):
                part.append(values)
    return [np.concatenate(p).astype(k) if p else np.zeros(0, k) for p, k in zip(out, _KINDS, strict=True)]


def sketched(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A batch's part of the sketch, and ranges of windows estimated repeated inside the batch.

    Of an anchor that the batch has more than once, one goes on and counts twice; the windows of all are in the ranges.
    """
    order = np.argsort(columns[0], kind="stable")
    h, row, lo, more, _ = (c[order] for c in columns)
    new = new_group(h)
    n = np.bincount(np.cumsum(new) - 1, minlength=1)[np.cumsum(new) - 1] if len(h) else np.zeros(0, int)
    again = n > 1
    kept = np.flatnonzero(new)
    kept = kept[np.lexsort((lo[kept], row[kept]))]  # by place, as packs like it
    return ([h[kept], row[kept], lo[kept], more[kept], np.minimum(n[kept], 2).astype(np.uint8)],
            _windows(row[again], lo[again], more[again]))


def estimated(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Merge the batches' parts of one slice: ranges of the windows whose estimate is two or more."""
    h, row, lo, more, count = columns
    one, two = (h & U(CELLS - 1)).astype(np.int64), (mix(h, h) & U(CELLS - 1)).astype(np.int64)
    estimate = np.minimum(np.bincount(one, count, CELLS)[one], np.bincount(two, count, CELLS)[two])
    new = (estimate >= 2) & (count == 1)  # what counts twice is in the ranges of its batch
    return _windows(row[new], lo[new], more[new])


def _windows(row: np.ndarray, lo: np.ndarray, more: np.ndarray) -> list[np.ndarray]:
    lo = lo.astype(np.int64)
    return [row, lo, lo + more + WINDOW, np.ones(len(row), bool)]


def repeated_ranges(rows: DataFrame, size: int) -> DataFrame:
    """``row_id, lo, hi`` of words to remove from ``rows`` (row_id, text) of ``size`` bytes; ranges may overlap."""
    buckets = bucket_count(rows.sparkSession, size)
    read = rows.select("row_id", "text")

    def dealt(going: list[np.ndarray], ranges: list[np.ndarray]) -> pa.RecordBatch:
        by_row = ranges[0].astype(U)  # what is decided only passes through
        return packed_batch([*tagged(b"s", pack(bucket_of(going[0], buckets), going)),
                             *tagged(b"r", pack(bucket_of(mix(by_row, by_row), buckets), ranges))])

    def joined(packs: list[bytes], ranges: list[np.ndarray]) -> pa.Table:
        passed = unpack_tagged(packs, b"r", RANGE_KINDS)
        return range_table(*(np.concatenate(x) for x in zip(ranges, passed, strict=True)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held(batches):
            yield dealt(*sketched(anchors(batch.column("text"), batch.column("row_id").to_numpy())))

    def sliced(table: pa.Table) -> pa.Table:
        packs = table["pack"].to_pylist()
        return joined(packs, estimated(unpack_tagged(packs, b"s", _KINDS)))

    def windows_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        row_id = batch.column("row_id").to_numpy()
        data, offsets = text_bytes(batch.column("text"))
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            words = Words(data[offsets[i]:offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
            at = np.concatenate([np.arange(lo, hi - WINDOW + 1) for lo, hi in
                                 merged([(s["lo"], s["hi"]) for s in spans], WINDOW - 1)])
            yield (run_hashes(words.hashes(0), WINDOW, 0)[at], run_hashes(words.hashes(1), WINDOW, 1)[at] >> U(32),
                   np.full(len(at), row_id[i]), at)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held(batches):
            for columns in string_batches(windows_of(batch)):
                yield dealt(*first_strings(columns, WINDOW))

    def grouped(table: pa.Table) -> pa.Table:
        packs = table["pack"].to_pylist()
        return joined(packs, first_strings(unpack_tagged(packs, b"s", STRING_KINDS), WINDOW)[1])

    asked = map_groups(map_batches(read, counted, PACKS), "bucket", sliced, RANGES)
    # a document's ranges are fewer than its words
    left = spans_of(asked)
    asked, _ = with_ids(read, left.select("row_id"))
    found = map_groups(map_batches(asked.join(left, "row_id"), windows, PACKS), "bucket", grouped, RANGES)
    return found.drop("open")


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed`` and ``kept`` (the words left, joined by one space) of each row of ``docs`` (doc_id, text).

    A word goes if a window of WINDOW words that covers it also starts earlier: in a smaller doc_id, or earlier in the same
    document. Windows are judged on the input. Words are what spaces, tabs and line ends (0x09 to 0x0D) part, unchanged. A null
    text has no words; texts under WINDOW words keep all; repeated rows are one document and give equal rows; see
    ``identified`` for rows of one doc_id and none. An empty table gives an empty one. With ``digest``, ``kept_sha256`` instead.
    """
    rows, size, _ = identified(docs)
    spans = spans_of(repeated_ranges(rows, size))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, removed, kept = [], [], []
            for text, own in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(),
                                 strict=True):
                words = text.split()  # of bytes: at the six signs above
                count.append(len(words))
                for lo, hi in reversed(merged([(s["lo"], s["hi"]) for s in own or []])):
                    del words[lo:hi]
                removed.append(count[-1] - len(words))
                kept.append(b" ".join(words))
            last = [hashlib.sha256(k).hexdigest() for k in kept] if digest else [k.decode() for k in kept]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()),
                                              pa.array(removed, pa.int64()), pa.array(last, pa.string())],
                                             ["doc_id", "n_words", "n_removed", last_name])

    last_name = "kept_sha256" if digest else "kept"
    return map_batches(with_spans(rows, spans).select("doc_id", "text", "spans"), cut,
                       f"doc_id long, n_words long, n_removed long, {last_name} string")


def op5_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
