"""Audit of sources: how far the words of each source are from those of the others and of its language.

The kept terms of a language are numbered, frequent ones first, and a source's counts become bitmaps: for each count that
occurs, the set of the terms that have it, in words of 64 terms. Two sources' joint counts are then what is left of their
bitmaps' AND; its population count times the divergence of that pair of counts adds up to the divergence of the sources. Counts
of zero have no bitmap: their cells are what the others leave over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm.arrays import blocks, held
from tidegrid.llm.ranks import numbered
from tidegrid.llm.terms import LETTERS, Terms
from tidegrid.llm.workers import map_batches, send_package
from tidegrid.session import materialize

#: Documents of a language that a kept term is in, at least; terms reported for a source.
LEAST_DOCUMENTS, MOST_TERMS = 3, 200
SCALE = 1_000_000_000
#: Bits of a term's number inside a chunk, whose bitmaps meet in one task, and sources of one side there.
CHUNK_BITS, SIDE = 15, 16
#: Terms counted in a task before they are sent.
HELD_TERMS = 1 << 18
#: Pairs of bitmap words that are worked on together.
PAIRS = 1 << 20


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term in every group, added up over all ``docs``.

    A null text, lang or source is ''. Each group also has a row of term null and n 0, whether it has terms or not. Terms are
    added up inside every task first, so a frequent word leaves it a few times only.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in held(batches):
            part = _batch_counts(batch)
            kept.append(part)
            size += len(part)
            if size > HELD_TERMS:
                kept = [_added(kept)]
                size = len(kept[0])
                if size > HELD_TERMS // 2:
                    yield from kept[0].to_batches()
                    kept, size = [], 0
        if kept:
            yield from _added(kept).to_batches()

    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    sent = map_batches(docs.select(*plain), count, "lang string, source string, term string, n long, docs long")
    return sent.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


_NAMES = ("lang", "source", "term")


def _added(tables: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(tables).group_by(list(_NAMES)).aggregate([("n", "sum"), ("docs", "sum")])
    return found.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select([*_NAMES, "n", "docs"])


def _batch_counts(batch: pa.RecordBatch) -> pa.Table:
    """The counts of one batch, exact: equal strings are found by dictionaries."""
    langs, sources = (batch.column(c).dictionary_encode() for c in _NAMES[:2])
    lang, source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (langs, sources))
    group, first, of_row = np.unique(lang * len(sources.dictionary) + source, return_index=True, return_inverse=True)
    out = []
    for at, data, offsets in blocks(batch.column("text")):
        terms = Terms(data, offsets, LETTERS)
        found = terms.texts().dictionary_encode()
        term, k = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(found.dictionary), 1)
        in_doc, times = np.unique(terms.row * k + term, return_counts=True)  # a term of a document
        key, back = np.unique(of_row[at + in_doc // k] * k + in_doc % k, return_inverse=True)
        n = np.zeros(len(key), np.int64)
        np.add.at(n, back, times)
        rows = first[key // k]
        out.append(pa.table([pc.take(batch.column("lang"), rows), pc.take(batch.column("source"), rows),
                             found.dictionary.take(pa.array(key % k)).cast(pa.string()), pa.array(n),
                             pa.array(np.bincount(back, minlength=len(key)))], [*_NAMES, "n", "docs"]))
    zero = pa.array(np.zeros(len(group), np.int64))
    out.append(pa.table([pc.take(batch.column("lang"), first), pc.take(batch.column("source"), first),
                         pa.nulls(len(group), pa.string()), zero, zero], [*_NAMES, "n", "docs"]))
    return _added(out)


def share(n: Column, size: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / size), exactly, for counts of any size."""
    wide = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", wide, size.cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _shares(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.array([1 + SCALE * (a + 1) // b if b else 0 for a, b in zip(n.tolist(), size.tolist(), strict=True)], np.int64)


def _divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // np.maximum(q, 1)  # at most 1e18


def tile(table: pa.Table) -> pa.Table:
    """The pairs of sources of one tile over the terms of one chunk: ``lang, a, b, value``, the sums of what they diverge.

    Rows with ``word`` null name a source of the tile: its side (0, 1 or, where both sides are the same sources, 2), ``size``
    (the sum of its counts plus the kept terms) and ``n`` (the terms of the chunk). The others are words of its bitmaps: for
    count ``n`` the 64 terms of ``word``, as ``bits``.
    """
    lang = table["lang"][0].as_py()
    gid, side, word, n, bits, size = (table[c].combine_chunks().fill_null(-1).to_numpy() for c in
                                      ("gid", "side", "word", "n", "bits", "size"))
    named = np.flatnonzero(word < 0)
    named = named[np.argsort(gid[named])]
    ids, in_chunk = gid[named], int(n[named[0]])
    rest = np.flatnonzero(word >= 0)
    own = np.searchsorted(ids, gid[rest])
    order = np.lexsort((own, word[rest]))
    rest, own = rest[order], own[order]
    word, n, bits = word[rest], n[rest], bits[rest].astype(np.uint64)
    terms = np.bitwise_count(bits).astype(np.int64)
    share_of = _shares(n, size[named][own])
    zero = _shares(np.zeros(len(ids), np.int64), size[named])
    used = np.bincount(own, terms, len(ids)).astype(np.int64)  # below 2**53
    left, right = np.flatnonzero(side[named] != 1), np.flatnonzero(side[named] != 0)
    value = np.zeros((len(ids), len(ids)), np.int64)
    # zeros by complement: every term of a counts as if b had none, and so the other way; joint cells correct both below
    for j in range(len(ids)):
        np.add.at(value[:, j], own, terms * _divergences(share_of, zero[j]))
        np.add.at(value[j], own, terms * _divergences(zero[j], share_of))
    value += (in_chunk - used[:, None] - used[None, :]) * _divergences(zero[:, None], zero[None, :])
    begin, end = np.searchsorted(word, word, "left"), np.searchsorted(word, word, "right")
    ends = np.cumsum(end - begin)
    at = 0
    while at < len(word):  # each bitmap word with all those over the same 64 terms
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        count = (end - begin)[at:to]
        x = np.repeat(np.arange(at, to), count)
        y = np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[at:to], count)
        joint = np.bitwise_count(bits[x] & bits[y]).astype(np.int64)
        some = np.flatnonzero((joint > 0) & (own[x] != own[y]))
        x, y, joint = x[some], y[some], joint[some]
        p, q, p0, q0 = share_of[x], share_of[y], zero[own[x]], zero[own[y]]
        f = _divergences(p, q) - _divergences(p, q0) - _divergences(p0, q) + _divergences(p0, q0)
        np.add.at(value.reshape(-1), own[x] * len(ids) + own[y], joint * f)
        at = to
    a, b = (x.reshape(-1) for x in np.meshgrid(left, right, indexing="ij"))
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    both = np.unique(a[a != b] * len(ids) + b[a != b])
    a, b = both // len(ids), both % len(ids)
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": ids[a], "b": ids[b], "value": value[a, b]})


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: what sets every source apart from its language and from the others.

    ``docs`` needs lang, source and text; null is '' in each, other columns are not read, and a doc_id is not needed: every row
    is a document, also repeated ones. Part ``pair`` has a row for every two sources of a language, in both directions, with
    value 0 where nothing is kept. Part ``term`` has the ``most_terms`` terms that a source uses most above its language.
    An empty table gives an empty one. All arithmetic is on whole numbers.
    """
    cells = materialize(count_terms(docs), "term-cells")
    kept = (cells.filter("term IS NOT NULL").groupBy("lang", "term")
            .agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).drop("docs"))
    kept = materialize(numbered(kept, ["lang", F.desc("all_n"), "term"], "id", "term-numbers")
                       .withColumn("id", F.col("id") - 1), "kept-terms")
    counts = materialize(cells.filter("term IS NOT NULL").select("lang", "source", "term", "n")
                         .join(kept, ["lang", "term"]), "kept-cells")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_n"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = (cells.filter("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left")
              .join(langs, "lang", "left").fillna(0, ["own_n", "terms", "lang_n"])
              .withColumn("gid", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"))
              .withColumn("size", F.col("own_n") + F.col("terms")))
    groups = materialize(groups, "groups")
    return _pairs(counts, kept, groups).unionByName(_terms(counts, groups, most_terms))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _terms(counts: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    p, q = share(F.col("n"), F.col("size")), share(F.col("all_n"), F.col("lang_n") + F.col("terms"))
    over = (counts.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
            .filter("p > q").withColumn("value", divergence(F.col("p"), F.col("q"))))
    return _ranked(over).filter(F.col("rank") <= most).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def _pairs(counts: DataFrame, kept: DataFrame, groups: DataFrame) -> DataFrame:
    # a word of a bitmap: of the 64 terms from id << 6 on, those that have this count in this source
    bit = F.expr("shiftleft(1L, CAST(id & 63 AS INT))")
    words = (counts.groupBy("lang", "source", "n", F.shiftright("id", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
             .join(groups.select("lang", "source", "gid", "size"), ["lang", "source"])
             .withColumn("chunk", F.shiftright("word", CHUNK_BITS - 6))
             .select("lang", "chunk", "gid", "word", "n", "bits", "size"))
    chunks = kept.groupBy("lang", F.shiftright("id", CHUNK_BITS).alias("chunk")).agg(F.count("*").alias("n"))
    null = F.lit(None).cast("long")
    names = (groups.select("lang", "gid", "size").join(chunks, "lang", "left").fillna(0, ["chunk", "n"])
             .select("lang", "chunk", "gid", null.alias("word"), "n", null.alias("bits"), "size"))
    # tiles of SIDE sources by SIDE sources: a task holds two sides of one chunk, however many sources there are
    sides = groups.groupBy("lang").agg(F.max("gid").alias("last"))
    own = F.expr(f"CAST(gid DIV {SIDE} AS INT)")
    rows = (words.unionByName(names).join(sides, "lang").withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.expr(f"CAST(last DIV {SIDE} AS INT)"))))
            .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
            .withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") == F.col("i"), 0).otherwise(1))
            .drop("own", "other", "last"))
    send_package(rows.sparkSession)
    sums = (rows.groupBy("lang", "chunk", "i", "j").applyInArrow(tile, "lang string, a long, b long, value long")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    name = groups.select("lang", "gid", "source")
    named = (sums.join(name.withColumnRenamed("gid", "a"), ["lang", "a"])
             .join(name.select("lang", F.col("gid").alias("b"), F.col("source").alias("item")), ["lang", "b"]))
    return _ranked(named).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
           FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS all_n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
lsize AS (SELECT lang, count(*) AS v, sum(all_n) AS n FROM kept GROUP BY lang),
gsize AS (SELECT g.lang, g.source, coalesce(any_value(v), 0) + coalesce(sum(c.n), 0) AS size
          FROM grp g LEFT JOIN lsize USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source
          GROUP BY g.lang, g.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.all_n,
             1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // g.size AS p
      FROM gsize g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, term AS item, p, 1 + 1000000000::HUGEINT * (all_n + 1) // (lsize.n + lsize.v) AS q
      FROM p JOIN lsize USING (lang) WHERE p.n > 0),
pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
          FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
ranked AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', item, ((p - q) * (p - q) // q)::BIGINT FROM t WHERE p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM ranked)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
