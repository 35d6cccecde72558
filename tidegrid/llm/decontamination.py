"""Benchmark passages in documents, by greedy string tiling.

Words of a document and of a test item are compared without regard to A-Z case. Runs of ``SEED`` words that both have, by
their running hash, are the seeds; the longest run of equal words that overlaps nothing marked yet is marked, again and again,
until none of ``SEED`` words is left. Order does not matter to the tiles, so a passage whose sentences were moved around is
still covered. A document is contaminated if the tiles of an item cover at least ``COVERAGE`` of its words.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.arrays import U, Words, blocks
from tidegrid.llm.workers import map_batches, texts_of

SEED = 5
COVERAGE = 0.5
#: Bytes of benchmark text that are sent to every task at once; a larger benchmark goes in several blocks, each over all rows.
SENT = 16 << 20
_BITS = 20


class Seeds:
    """Items ready to be looked up: their words' hashes, and every run of SEED words with its item and place."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        _, data, offsets = next(blocks(pa.array(texts, pa.string()), 1 << 62), (0, np.zeros(0, np.uint8), np.zeros(1, int)))
        words = Words(data, offsets, lower=True)
        h = words.hashes()
        # an item under SEED words is one run of all its words
        self.words = [h[b:e] for b, e in zip(words.begin[:-1], words.begin[1:], strict=True)]
        run, at = words.runs(SEED)
        order = np.argsort(run, kind="stable")
        self.run, self.item = run[order], words.row[at][order]
        self.place = (at - words.begin[words.row[at]])[order]
        self.some = np.zeros(1 << _BITS, bool)
        self.some[_short(self.run)] = True

    def hits(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For runs of documents: which of them, and the item and place of each equal run."""
        maybe = np.flatnonzero(self.some[_short(run)])
        left = np.searchsorted(self.run, run[maybe], "left")
        n = np.searchsorted(self.run, run[maybe], "right") - left
        which = np.repeat(maybe, n)
        at = np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(int), n) + np.arange(n.sum())
        return which, self.item[at], self.place[at]


def _short(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - _BITS)).astype(np.int64)


def tiles(doc_at: np.ndarray, item_at: np.ndarray, seed: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (place in the document, place in the item, words) from the places where runs of ``seed`` words are equal.

    Longest first; of equally long ones the first in the document, then in the item. A run that overlaps a marked one is cut
    to its longest free part and waits for its turn again.
    """
    order = np.lexsort((doc_at, doc_at - item_at))
    d, i = doc_at[order], item_at[order]
    new = np.ones(len(d), bool)  # seeds next to each other on one diagonal are one run
    new[1:] = (np.diff(d) != 1) | (np.diff(i) != 1)
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(d))) + seed - 1
    waiting = [(-int(n), int(d[b]), int(i[b])) for b, n in zip(begin, length, strict=True)]
    heapq.heapify(waiting)
    doc_marked: set[int] = set()
    item_marked: set[int] = set()
    out = []
    while waiting:
        n, a, b = heapq.heappop(waiting)
        free, size = [], 0
        for k in range(-n + 1):
            if k < -n and a + k not in doc_marked and b + k not in item_marked:
                size += 1
            elif size:
                free.append((k - size, size))
                size = 0
        if free == [(0, -n)]:
            out.append((a, b, -n))
            doc_marked.update(range(a, a - n))
            item_marked.update(range(b, b - n))
        else:
            for k, size in free:
                if size >= seed:
                    heapq.heappush(waiting, (-size, a + k, b + k))
    return out


def _overlaps(column: pa.Array, seeds: Seeds) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item's index, words of the item, words covered, tiles) for every row and item with a tile."""
    for first, data, offsets in blocks(column):
        words = Words(data, offsets, lower=True)
        run, at = words.runs(SEED)
        which, item, place = seeds.hits(run)
        if not len(which):
            continue
        row = words.row[at[which]]
        doc_at = at[which] - words.begin[row]
        order = np.lexsort((item, row))
        row, item, place, doc_at = row[order], item[order], place[order], doc_at[order]
        begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])]))
        for b, e in zip(begin, np.append(begin[1:], len(row)), strict=True):
            found = tiles(doc_at[b:e], place[b:e])
            yield first + int(row[b]), int(item[b]), len(seeds.words[item[b]]), sum(t[2] for t in found), len(found)


def benchmark_blocks(benchmark: DataFrame, limit: int = SENT) -> list[tuple[list[int], list[str]]]:
    """Items (item_id, text) in blocks of at most ``limit`` bytes of text, or of one item. Items without words say nothing."""
    out: list[tuple[list[int], list[str]]] = []
    size = 0
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL")
    for r in items.distinct().orderBy("item_id", "text").toLocalIterator():
        if not out or size + len(r["text"].encode()) > limit:
            out.append(([], []))
            size = 0
        out[-1][0].append(r["item_id"])
        out[-1][1].append(r["text"])
        size += len(r["text"].encode())
    return out


OVERLAPS = ("doc_id long, item_id long, item_words long, covered_words long, n_tiles long, coverage double, "
            "contaminated boolean")


def overlaps(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Every document (doc_id, text) and item (item_id, text) that share a tile, and whether the tiles cover enough of the item.

    Texts are read whole; other columns are not read. Null and empty texts, and items under SEED words, share nothing. Repeated
    rows give equal rows; repeated items count once; null ids are kept. Without items or documents there are no rows.
    """
    def find(seeds_of: tuple[list[int], list[str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(*seeds_of)
            for batch in batches:
                rows = list(_overlaps(batch.column("text"), seeds))
                if rows:
                    row, item, n, covered, count = zip(*rows, strict=True)
                    share = np.array(covered) / np.array(n)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(row)), pa.array([seeds.ids[i] for i in item], pa.int64()),
                         pa.array(n, pa.int64()), pa.array(covered, pa.int64()), pa.array(count, pa.int64()),
                         pa.array(share), pa.array(share >= coverage)],
                        ["doc_id", "item_id", "item_words", "covered_words", "n_tiles", "coverage", "contaminated"])
        return run

    parts = [map_batches(texts_of(docs), find(block), OVERLAPS) for block in benchmark_blocks(benchmark)]
    if not parts:
        return docs.sparkSession.createDataFrame([], OVERLAPS)
    while len(parts) > 1:
        parts = [a.unionAll(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2:]
    return parts[0]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that no item of the benchmark is in.

    A null or empty text holds none and stays; rows without doc_id and repeated rows are judged like any other. An empty
    benchmark leaves all rows, and an empty table gives an empty one.
    """
    at = docs.columns.index(text)
    out = docs
    for block in benchmark_blocks(benchmark):
        def keep(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(*block)
            for batch in batches:
                kept = np.ones(len(batch), bool)
                for row, _, n, covered, _ in _overlaps(batch.column(at), seeds):
                    kept[row] &= covered / n < coverage
                yield batch.filter(pa.array(kept))

        out = map_batches(out, keep, docs.schema)
    return out


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item and how much of it."""
    found = overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter("contaminated").drop("contaminated")
