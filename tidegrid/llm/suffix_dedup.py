"""Repeated byte strings, by prefix doubling over sampled positions.

Names of 1, 2, 4, ... bytes are made from pairs of names of half the length, up to 64 bytes, where the text is. From there
Spark sorts. Sorting every position of a corpus by rank pairs would move over twenty times its bytes, so positions are
sampled without loss: each string of ``LENGTH`` bytes has an anchor, the place inside it where the name of ``ANCHOR`` bytes
is smallest, and equal strings have equal anchors in the same place.

Round 1 sorts the anchors by (name, name of all that the strings of this anchor cover). Anchors whose name is unique are done:
none of their strings repeats. Where the whole context is equal to that of an earlier anchor, all its strings repeat. Round 2
takes the strings of the anchors that are left and sorts them by the pair (name at 0, name at 64) past the threshold,
under two independent hashes. All but the first string of a rank repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.arrays import U, blocks, byte_values, held, mix, window_minima
from tidegrid.llm.exchange import (PACKS, bucket_count, bucket_of, identified, new_group, pack, packed_batch, tagged,
                                   unpack_tagged, with_ids)
from tidegrid.llm.ranges import (RANGE_KINDS, RANGES, STRING_KINDS, first_strings, merged, range_table, spans_of,
                                 string_batches, with_spans)
from tidegrid.llm.workers import map_batches, map_groups
from tidegrid.session import materialize

LENGTH, ANCHOR = 100, 36
#: Bytes worked on together; a place in them has PLACE bits. Longer texts are worked on in pieces that overlap.
PIECE, PLACE = 1 << 18, 20
#: Contexts of one name in one batch from which on the name is taken as repeated right away.
MANY = 8
_VALUES = {lane: byte_values(lane) for lane in range(2)}
ANCHOR_KINDS = (np.uint64, np.uint64, np.int64, np.int32, np.uint8, np.uint8)


def names(data: np.ndarray, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of each place, the names of 36 and of 64 bytes; those that begin too late for the block have some value."""
    level, size, kept = _VALUES[lane][data], 1, {}
    while size < 64:
        ahead = np.zeros_like(level)
        ahead[:-size or None] = level[size:] if size < len(level) else 0
        level = mix(level, ahead, lane)
        size *= 2
        if size in (4, 32):
            kept[size] = level
    short = np.zeros_like(level)
    if len(level) > 32:
        short[:-32] = mix(kept[32][:-32], kept[4][32:], lane)
    return short, level


def whole_names(data: np.ndarray, at: np.ndarray, lane: int) -> np.ndarray:
    """The names of LENGTH bytes at these places."""
    short, long = names(data, lane)
    return mix(long[at], short[at + 64], lane)


def anchors(column: pa.Array, row_id: np.ndarray) -> list[np.ndarray]:
    """Anchors of a column of texts: name, context, row_id, first string, strings - 1, and 0."""
    out: list[list[np.ndarray]] = [[] for _ in ANCHOR_KINDS]
    for first, whole, ends in blocks(column, PIECE):
        pieces = [(0, whole, ends)] if len(whole) <= PIECE else [
            (b, whole[b:b + PIECE + LENGTH - 1], np.array([0, min(PIECE + LENGTH - 1, len(whole) - b)]))
            for b in range(0, len(whole), PIECE)]
        for base, data, offsets in pieces:
            if len(data) < LENGTH:
                continue
            short, long = names(data)
            place = U((1 << PLACE) - 1) - np.arange(len(data), dtype=U)
            low = window_minima((short >> U(PLACE) << U(PLACE)) | place, LENGTH - ANCHOR + 1)[:len(data) - LENGTH + 1]
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            p = np.flatnonzero(row[:len(low)] == row[LENGTH - 1:])
            a = ((1 << PLACE) - 1) - (low[p] & U((1 << PLACE) - 1)).astype(np.int64)
            if not len(p):
                continue
            new = new_group(a) | np.concatenate([[True], np.diff(p) != 1])
            begin = np.flatnonzero(new)
            lo, hi = p[begin], p[np.append(begin[1:], len(p)) - 1]
            a = a[begin]
            sides = ((hi - lo) << 8 | (a - lo)).astype(U)
            context = mix(mix(long[lo], long[(lo + hi + 36) // 2]), mix(long[hi + 36], sides))
            own = row[lo]
            for part, values in zip(out, (short[a], context, row_id[first + own], lo - offsets[own] + base, hi - lo,
                                          np.zeros(len(lo))), strict=True):
                part.append(values)
    return [np.concatenate(p).astype(k) if p else np.zeros(0, k) for p, k in zip(out, ANCHOR_KINDS, strict=True)]


def sort_anchors(columns: list[np.ndarray], last: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rank anchors by (name, context): those still undecided, and ranges (row_id, lo, hi, open) that are decided.

    Before the shuffle (``last`` false) later copies of a context are covered and leave; of a name with many contexts one goes
    on, flagged, and the others are open. In the bucket (``last``) unique names leave, and what is left is open.
    """
    name, context, row, lo, more, flag = columns
    order = np.lexsort((lo, row, context, name))
    name, context, row, lo, more, flag = (c[order] for c in (name, context, row, lo, more, flag))
    new_name, new = new_group(name), new_group(name, context)
    begin = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    # a row that is there twice meets itself: only strings of later places repeat
    later = (row != row[begin][group]) | (lo != lo[begin][group])
    hi = lo + more.astype(np.int64) + LENGTH
    covered = ~new & later
    kept = new
    of_name = np.cumsum(new_name[kept]) - 1
    contexts = np.bincount(of_name) if kept.any() else np.zeros(0, int)
    flagged = np.zeros(len(contexts), bool)
    np.logical_or.at(flagged, np.cumsum(new_name) - 1, flag > 0)  # also of rows that are covered here
    if last:
        opened = (contexts > 1) | flagged
        open_ = opened[of_name]
        on = np.zeros(len(open_), bool)
    else:
        many = contexts >= MANY
        first = new_name[kept]
        open_ = many[of_name]
        on = ~open_ | first
        flag = flag.copy()
        flag[np.flatnonzero(kept)[open_ & first]] = 1
    at = np.flatnonzero(kept)
    going = at[on]
    going = going[np.lexsort((lo[going], row[going]))]  # by place, as packs like it
    ranges = [np.concatenate([c[covered], c[at[open_]]]) for c in (row, lo.astype(np.int64), hi)]
    ranges.append(np.concatenate([np.zeros(covered.sum(), bool), np.ones(open_.sum(), bool)]))
    return [c[going] for c in (name, context, row, lo, more, flag)], ranges


def repeated_ranges(rows: DataFrame, size: int) -> DataFrame:
    """``row_id, lo, hi`` of bytes to remove from ``rows`` (row_id, text) of ``size`` bytes; ranges may overlap."""
    buckets = bucket_count(rows.sparkSession, size)
    read = rows.select("row_id", "text")

    def dealt(going: list[np.ndarray], ranges: list[np.ndarray]) -> pa.RecordBatch:
        by_row = ranges[0].astype(U)  # what is decided only passes through
        return packed_batch([*tagged(b"s", pack(bucket_of(going[0], buckets), going)),
                             *tagged(b"r", pack(bucket_of(mix(by_row, by_row), buckets), ranges))])

    def joined(packs: list[bytes], ranges: list[np.ndarray]) -> pa.Table:
        passed = unpack_tagged(packs, b"r", RANGE_KINDS)
        return range_table(*(np.concatenate(x) for x in zip(ranges, passed, strict=True)))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held(batches):
            yield dealt(*sort_anchors(anchors(batch.column("text"), batch.column("row_id").to_numpy()), False))

    def ranked(table: pa.Table) -> pa.Table:
        packs = table["pack"].to_pylist()
        return joined(packs, sort_anchors(unpack_tagged(packs, b"s", ANCHOR_KINDS), True)[1])

    def strings_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        row_id, spans = batch.column("row_id").to_numpy(), batch.column("spans").to_pylist()
        for first, data, offsets in blocks(batch.column("text"), PIECE):
            for base in range(0, len(data), PIECE):  # a long text in pieces, else once
                end = min(len(data), base + PIECE + LENGTH - 1) if len(data) > PIECE else len(data)
                row, at = [], []
                for i in range(len(offsets) - 1):
                    for lo, hi in merged([(s["lo"], s["hi"]) for s in spans[first + i]], LENGTH - 1):
                        lo, hi = max(lo, base), min(hi - LENGTH + 1, base + PIECE if len(data) > PIECE else hi)
                        if lo < hi:
                            row.append(np.full(hi - lo, i))
                            at.append(np.arange(lo, hi))
                if at:
                    row, at = np.concatenate(row), np.concatenate(at)
                    piece, place = data[base:end], offsets[row] + at - base
                    yield whole_names(piece, place, 0), whole_names(piece, place, 1) >> U(32), row_id[first + row], at

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held(batches):
            for columns in string_batches(strings_of(batch)):
                yield dealt(*first_strings(columns, LENGTH))

    def grouped(table: pa.Table) -> pa.Table:
        packs = table["pack"].to_pylist()
        return joined(packs, first_strings(unpack_tagged(packs, b"s", STRING_KINDS), LENGTH)[1])

    decided = materialize(map_groups(map_batches(read, sampled, PACKS), "bucket", ranked, RANGES), "anchors")
    # a document's ranges are fewer than its bytes
    left = materialize(decided.filter("open").groupBy("row_id")
                       .agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "open-ranges")
    asked, _ = with_ids(read, left.select("row_id"))
    found = map_groups(map_batches(asked.join(left, "row_id"), strings, PACKS), "bucket", grouped, RANGES)
    return decided.filter("NOT open").unionAll(found).drop("open")


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans`` and ``kept`` (binary: the bytes left) of each row of ``docs`` (doc_id, text).

    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a smaller doc_id, or earlier in the same
    document. Strings are judged on the input. A null text is empty; texts under LENGTH bytes keep all; repeated rows are one
    document and give equal rows; see ``identified`` for rows of one doc_id and none. An empty table gives an empty one.
    With ``digest`` the bytes left come as ``kept_sha256``. What is left need not be UTF-8, so it is not text.
    """
    rows, size, _ = identified(docs)
    spans = spans_of(repeated_ranges(rows, size))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            removed, count, kept = [], [], []
            for text, own in zip(texts, batch.column("spans").to_pylist(), strict=True):
                joined = merged([(s["lo"], s["hi"]) for s in own or []])
                left, at = [], 0
                for lo, hi in joined:
                    left.append(text[at:lo])
                    at = hi
                kept.append(b"".join([*left, text[at:]]))
                removed.append(len(text) - len(kept[-1]))
                count.append(len(joined))
            last = pa.array([hashlib.sha256(k).hexdigest() for k in kept]) if digest else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(count, pa.int64()), last], ["doc_id", "n_bytes", "n_removed", "n_spans", last_name])

    last_name = "kept_sha256" if digest else "kept"
    return map_batches(with_spans(rows, spans).select("doc_id", "text", "spans"), cut,
                       f"doc_id long, n_bytes long, n_removed long, n_spans long, {last_name} {'string' if digest else 'binary'}")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
