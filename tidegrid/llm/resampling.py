"""Importance resampling towards a target: documents that look like the target's are drawn more often.

Features are runs of words, hashed into a table of buckets. The counts of all documents and of the target give every bucket a
gain, the logarithm of how much likelier it is in the target; a document weighs the sum of its features' gains. Adding Gumbel
noise, a hash of its id, and taking the highest scores draws without replacement in proportion to the weights' exponentials.

Which scores are the highest is found by quickselect over the written scores: random keys as pivots, exact counts below, at and
above each, and the interval that holds the wanted key, until a pivot is that key. Only the drawn documents are then sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.arrays import blocks
from tidegrid.llm.ranks import numbered
from tidegrid.llm.terms import LETTERS_AND_DIGITS, Terms
from tidegrid.llm.workers import map_batches
from tidegrid.session import materialize

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
#: Documents of fewer features are not drawn; of the others this many in a hundred are.
LEAST, PERCENT = 20, 10
#: Pivots of one round: the interval shrinks by about as many times.
PIVOTS = 12
#: The columns that order documents: highest score, smallest doc_id (null last), then text and row, so that no two are alike.
KEY = ("down", "no_id", "id", "tie", "copy")


def features(data: np.ndarray, offsets: np.ndarray, longest: int = LONGEST,
             buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each number of words up to ``longest``: the bucket of every run of so many words, and its row in the block."""
    terms = Terms(data, offsets, LETTERS_AND_DIGITS)
    found = (terms.checksums(n) for n in range(1, longest + 1))
    return [((crc % np.uint32(buckets)).astype(np.int64), row) for crc, row in found]


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``texts`` (text; other columns are not read) fall into each bucket.

    Every task adds up its own array and sends the buckets it has met; the driver gets one row for each bucket.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in blocks(batch.column("text")):
                for bucket, _ in features(data, offsets, longest, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    sent = map_batches(texts.select(F.col("text").cast("string")), count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in sent.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(((t + 1) * (S + B)) / ((s + 1) * (T + B)))) of each of B buckets, in doubles."""
    size, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + size) / ((float(s) + 1) * (t_all + size))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """``doc_id, n_features, weight`` and ``tie``, a hash of the text, for each row of ``docs`` (doc_id, text)."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column("text")):
                rows = len(offsets) - 1
                n, weight = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                for bucket, row in features(data, offsets, longest, len(gain)):
                    begin = np.searchsorted(row, np.arange(rows + 1))
                    n += np.diff(begin)
                    total = np.concatenate([[0], np.cumsum(gain[bucket])])
                    weight += total[begin[1:]] - total[begin[:-1]]
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(weight), part.column("tie")],
                                                 ["doc_id", "n_features", "weight", "tie"])

    text = F.col("text").cast("string")
    read = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("tie"))
    return map_batches(read, add, "doc_id long, n_features long, weight long, tie long")


def _noise(seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))), u from the first 8 hex digits of sha256 of ``seed:doc_id`` (null: nothing after the colon)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    u = (h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def _key(values=None) -> Column:
    """The key of a row, or of ``values``, as one column that compares like a tuple."""
    return F.struct(*(F.col(c) if values is None else F.lit(v).cast("long").alias(c) for c, v in zip(KEY, values or KEY)))


def kth_key(keyed: DataFrame, k: int, seed: int = SEED, pivots: int = PIVOTS) -> tuple[int, ...] | None:
    """The ``k``-th smallest key (from 1) among rows whose keys all differ; None if there are fewer.

    ``keyed`` is read again in every round and so should be written. A round takes the ``pivots`` keys of the smallest hashes
    inside the interval, counts the rows below and at each exactly, and goes on in the interval that holds the wanted one. The
    driver holds these few keys and counts only.
    """
    low = high = None
    before, turn = 0, 0  # rows up to and with the lower end
    while True:
        inside = keyed
        for bound, beyond in ((low, True), (high, False)):
            if bound is not None:  # the first column alone is a filter that reaches the scan
                at = F.col("down") >= bound[0] if beyond else F.col("down") <= bound[0]
                inside = inside.filter(at).filter(_key() > _key(bound) if beyond else _key() < _key(bound))
        drawn = inside.orderBy(F.xxhash64(*KEY, F.lit(seed + turn)), *KEY).select(*KEY).limit(pivots).collect()
        if not drawn:
            return None
        drawn = sorted(tuple(r) for r in drawn)
        counts = inside.agg(*(F.sum((_key() < _key(p)).cast("long")).alias(f"below{i}") for i, p in enumerate(drawn)),
                            *(F.sum((_key() == _key(p)).cast("long")).alias(f"at{i}") for i, p in enumerate(drawn))).first()
        start = before
        for i, p in enumerate(drawn):
            below, at = start + counts[f"below{i}"], counts[f"at{i}"]
            if k <= below:
                high = p
                break
            if k <= below + at:
                return p
            low, before = p, below + at
        turn += 1


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, seed: int = SEED,
             longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for each row of ``docs`` (doc_id, text); rank is null for those not drawn.

    Of the rows with at least ``least`` features, the floor of ``percent`` in a hundred of highest score are drawn and ranked
    from 1, ties by the smaller doc_id. ``target`` needs a text; other columns of either table are not read. A null text has no
    features, weighs 0 and is not drawn (with ``least`` over 0). A null doc_id hashes as nothing after the seed and comes last
    among equal scores. Rows that repeat a doc_id are rows of their own, ordered by a hash of the text; of equal rows any may be
    drawn, which cannot be seen. Empty tables: an empty target counts 0 everywhere; no documents give no rows.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scored = weigh(docs, gain, longest).withColumn("score", F.col("weight") + _noise(seed))
    scored = materialize(scored.withColumn("down", -F.col("score")).withColumn("no_id", F.col("doc_id").isNull().cast("long"))
                         .withColumn("id", F.coalesce("doc_id", F.lit(0))).withColumn("tie", F.coalesce("tie", F.lit(0)))
                         .withColumn("copy", F.monotonically_increasing_id()), "scores")
    able = scored.filter(F.col("n_features") >= least)
    wanted = able.count() * percent // 100
    last = kth_key(able, wanted, seed) if wanted else None
    out = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_features") >= least) & (_key() <= _key(last))
    winners = numbered(scored.filter(drawn).select(*out, *KEY), KEY, "rank", "drawn")
    return winners.select(*out, "rank").unionByName(scored.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: crc32 is spelt out over the bytes of each distinct word.
SQL = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
           FROM documents),
b AS (SELECT translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark),
dw AS (SELECT row, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM d),
bw AS (SELECT unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM b),
words AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
hashed AS (SELECT word, hex(encode(word)) AS h FROM words),
crc AS (SELECT word, xor(list_reduce(
          list_prepend(4294967295::BIGINT,
            list_transform(range(1, length(h) + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
          lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)::BIGINT[]),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)),
          4294967295::BIGINT) % 10000 AS bucket FROM hashed),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN crc USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN crc USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE
                / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS g
         FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT row, count(*) AS n_features, sum(g)::BIGINT AS weight
      FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY row),
scored AS (SELECT d.row, doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
               / 4294967296::DOUBLE)))::BIGINT AS score
           FROM d LEFT JOIN w USING (row)),
places AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM places) THEN place END::BIGINT AS rank
FROM scored LEFT JOIN places USING (row)
"""
