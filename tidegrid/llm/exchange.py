"""Arrays dealt to tasks in packs: a row of a shuffle holds what one batch has for one bucket, as plain numbers.

A bucket is a slice of a 64-bit hash. There are enough of them that each holds a bounded part of the input, whatever the
input's size, and hot values are thinned out inside each batch before they are packed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.arrays import U
from tidegrid.session import materialize

PACKS = "bucket int, pack binary"
#: Bytes of text whose packs meet in one bucket, about.
BUCKET = 16 << 20


def bucket_count(spark, text_bytes: int, per_bucket: int = BUCKET) -> int:
    """Buckets for a corpus of this size: at least a few for each shuffle partition."""
    return int(max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), text_bytes // per_bucket + 1))


def bucket_of(h: np.ndarray, count: int) -> np.ndarray:
    return ((h >> U(32)) * U(count) >> U(32)).astype(np.int32)


def pack(bucket: np.ndarray, columns: Sequence[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """One pack of the columns' values for each bucket, in their order: those that ascend become small."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    order = np.argsort(bucket, kind="stable")
    columns = [c[order] for c in columns]
    bucket = bucket[order]
    begin = np.flatnonzero(new_group(bucket))
    for b, e in zip(begin, np.append(begin[1:], len(bucket))[:len(begin)], strict=True):
        yield int(bucket[b]), squeeze(np.int64(e - b).tobytes() + b"".join(c[b:e].tobytes() for c in columns))


def unpack(packs: Iterable[bytes], kinds: Sequence[type]) -> list[np.ndarray]:
    """The columns of all packs, one after the other."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    expand = zstandard.ZstdDecompressor().decompress
    for p in map(expand, packs):
        n, at = int(np.frombuffer(p, np.int64, 1)[0]), 8
        for part, kind in zip(parts, kinds, strict=True):
            part.append(np.frombuffer(p, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds, strict=True)]


def packed_batch(packs: Iterable[tuple[int, bytes]]) -> pa.RecordBatch:
    rows = list(packs)
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()),
                                       pa.array([p for _, p in rows], pa.binary())], ["bucket", "pack"])


def tagged(tag: bytes, packs: Iterable[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Packs of several kinds meet in one bucket; a byte before each tells them apart."""
    return [(b, tag + p) for b, p in packs]


def unpack_tagged(packs: Iterable[bytes], tag: bytes, kinds: Sequence[type]) -> list[np.ndarray]:
    return unpack([p[1:] for p in packs if p[:1] == tag], kinds)


def new_group(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted keys differs from the row before."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


#: Ids that may be sent to every task, 8 bytes each.
SENT_IDS = 1 << 22


def with_ids(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The ``rows`` whose row_id is in ``ids`` (distinct), and the others.

    Up to SENT_IDS ids are sent to where the rows are, and none of them moves. With more, ids and rows are dealt by row_id,
    and None stands for the others: a join by row_id that follows finds both dealt already.
    """
    if ids.count() > SENT_IDS:
        return rows.join(ids.select("row_id"), "row_id", "left_semi"), None
    marked = rows.join(F.broadcast(ids.select("row_id", F.lit(True).alias("hit"))), "row_id", "left")
    return marked.filter("hit").drop("hit"), marked.filter("hit IS NULL").drop("hit")


def identified(docs: DataFrame, rest: bool = False) -> tuple[DataFrame, int, bool]:
    """``doc_id, row_id, text`` of ``docs``, the bytes of all texts, and whether doc_id is unique and never null.

    With ``rest``, also all columns of ``docs`` as they are, in a struct of that name.

    ``row_id`` tells documents apart and orders them as doc_id does; it is doc_id where that is unique and never null. Else
    rows of the same doc_id and text are one document, rows of the same doc_id are in the order of their texts' hashes, and
    rows without doc_id come last. A null text is an empty one.
    """
    more = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")] if rest else []
    read = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
    n, ids, size = read.agg(F.count("*"), F.count_distinct("doc_id"), F.sum(F.octet_length("text"))).first()
    if n == ids:
        return read.withColumn("row_id", F.col("doc_id")), size or 0, True
    hashed = read.withColumn("hash", F.sha2("text", 256))
    order = materialize(hashed.select("doc_id", "hash").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "hash")
                        .withColumn("row_id", F.monotonically_increasing_id()), "row-ids")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.hash") == F.col("b.hash"))
    return hashed.alias("a").join(order.alias("b"), same).select("b.row_id", "a.*").drop("hash"), size or 0, False
