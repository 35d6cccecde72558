"""Documents whose sets of word shingles overlap, by token-combination prefixes.

A document's tokens are its distinct shingles of ``WORDS`` words, in one order for all: first the rare class, then the frequent
one. Two sets of n and m tokens with a Jaccard similarity of at least t share t * max(n, m) of them, so of the first
n - t * n + 1 tokens of either at least one is shared. A document whose first tokens are all rare is indexed by each of them.
One that has too few rare tokens extends its prefix by one and is indexed by its rare tokens and by all pairs of the frequent
tokens in it: two such documents share a rare token or two frequent ones. Where the pairs would be too many (documents made
of frequent tokens) it is indexed by single frequent tokens, and so are those it may meet, in an index of their own. Of the
frequent tokens the rarer ones come first.

Documents with equal sets are one node. Only links that can join components are needed: an entry of the index offers its
members to each other over growing distances, and members that are in one component already are skipped. In the end every two
members of every entry have been compared or are connected, so no link between components is missed.

Members are compared where they meet by the parities of their sets: bit i says whether the number of tokens that end in i is
odd. Where two parities differ the sets differ, in a token for each bit at least, so a pair with too many such bits is not
similar. Only what passes, hardly any pair under a similarity of 0.72, becomes a row and is verified token by token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.arrays import U, Words, blocks, held, mix, run_hashes
from tidegrid.llm.components import components
from tidegrid.llm.exchange import (PACKS, bucket_count, bucket_of, identified, new_group, pack, packed_batch, unpack,
                                   with_ids)
from tidegrid.llm.workers import map_batches, map_groups
from tidegrid.session import materialize

WORDS = 5
#: Similarity of at least NUMERATOR / 100.
NUMERATOR = 75
#: Documents that a token must be in to be frequent; raised until at most MOST tokens are, as these go to every task.
FREQUENT, MOST = 12, 1 << 20
#: Frequent tokens of a prefix up to which their pairs are indexed.
PAIRED = 12
#: Members of an entry are compared with the next NEAR first, then with GROWTH times as many in each round. A task has SPAN
#: members of an entry and those that follow them within the distance.
NEAR, GROWTH, SPAN = 4, 16, 1024
#: Bits of a parity for each token at least, and bytes of parities compared by one call.
BITS, COMPARED = 8, 4 << 20
_ENTRY_KINDS = (np.uint64, np.int64, np.int32, np.uint8)
#: Entries of single tokens, and how their members were indexed: by rare tokens, pairs, or frequent tokens in an index of
#: their own, where two members that also have pairs (LIGHT) need not meet.
PLAIN, LIGHT, HEAVY = 0, 1, 2


def shingles(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, A-Z lower-cased; of fewer words all of them are one, of none there is none."""
    for _, data, offsets in blocks(column):
        words = Words(data, offsets, lower=True)
        h = words.hashes()
        runs = run_hashes(h, WORDS)
        for n, begin in zip(words.count, words.begin[:-1], strict=True):
            if n >= WORDS:
                yield np.unique(runs[begin:begin + n - WORDS + 1])
            elif n:
                yield mix(run_hashes(h[begin:begin + n], int(n))[:1], np.array([n], U))
            else:
                yield np.zeros(0, U)


def least_overlap(n: int) -> int:
    """Tokens that a set of n shares at least with any that is similar to it."""
    return -(-NUMERATOR * n // 100)


def similar(shared: int, n: int, m: int) -> bool:
    return 100 * shared >= NUMERATOR * (n + m - shared)


def _cell(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where a token is counted: a bucket and 32 bits of its hash. Tokens that share a cell count as one, which costs order only."""
    g = mix(h, h)
    return bucket_of(g, buckets).astype(U) << U(32) | g & U(0xFFFFFFFF)


def frequent_tokens(rows: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cells of the tokens that are in the most documents, MOST at most, and the power of two of documents each is in."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held(batches):
            parts = list(shingles(batch.column("text")))
            cells, n = np.unique(_cell(np.concatenate([np.zeros(0, U), *parts]), buckets), return_counts=True)
            once = n == 1
            low = (cells & U(0xFFFFFFFF)).astype(np.uint32)
            bucket = (cells >> U(32)).astype(np.int32)
            yield packed_batch([*((b, b"1" + p) for b, p in pack(bucket[once], [low[once]])),
                                *((b, b"n" + p) for b, p in pack(bucket[~once], [low[~once], n[~once]]))])

    def summed(table: pa.Table) -> pa.Table:
        packs = table["pack"].to_pylist()
        (one,) = unpack([p[1:] for p in packs if p[:1] == b"1"], (np.uint32,))
        low, n = unpack([p[1:] for p in packs if p[:1] == b"n"], (np.uint32, np.int64))
        cells, where = np.unique(np.concatenate([one, low]), return_inverse=True)
        total = np.bincount(where, np.concatenate([np.ones(len(one)), n]), len(cells)).astype(np.int64)
        often = total >= FREQUENT
        cell = (table["bucket"][0].as_py() << 32) + cells[often].astype(np.int64)
        return pa.table({"cell": pa.array(cell, pa.int64()), "n": pa.array(total[often], pa.int64())})

    packs = map_batches(rows.select("text"), counted, PACKS)
    found = materialize(map_groups(packs, "bucket", summed, "cell long, n long"), "token-counts")
    power = F.floor(F.log2("n")).cast("int")
    by_power = {r["power"]: r["count"] for r in found.groupBy(power.alias("power")).count().collect()}
    kept, least = 0, 1 << 62
    for p in sorted(by_power, reverse=True):
        if kept + by_power[p] > MOST:
            break
        kept, least = kept + by_power[p], 1 << p
    cells = found.filter(F.col("n") >= least).select("cell", power.alias("power")).collect()  # MOST at most
    cell, powers = np.array([r["cell"] for r in cells], U), np.array([r["power"] for r in cells], np.uint8)
    order = np.argsort(cell)
    return cell[order], powers[order]


def entries(tokens: np.ndarray, powers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index entries of one set (sorted), and the kind of each; ``powers`` is 0 where a token is rare, else how frequent."""
    n = len(tokens)
    first = n - least_overlap(n) + 1
    frequent = powers > 0
    rare, often = tokens[~frequent], tokens[frequent]
    often = often[np.argsort(powers[frequent], kind="stable")]
    if len(rare) >= first:
        return rare[:first], np.full(first, PLAIN, np.uint8)
    single = often[:first - len(rare)]
    kinds = [np.full(len(rare), PLAIN, np.uint8)]
    keys = [rare]
    more = often[:first - len(rare) + 1]
    if len(more) <= PAIRED and len(more) == first - len(rare) + 1:
        i, j = np.triu_indices(len(more), 1)
        keys += [mix(more[i], more[j]), mix(single, U(LIGHT) + np.zeros_like(single))]
        kinds += [np.full(len(i), PLAIN, np.uint8), np.full(len(single), LIGHT, np.uint8)]
    else:
        keys.append(mix(single, U(LIGHT) + np.zeros_like(single)))
        kinds.append(np.full(len(single), HEAVY, np.uint8))
    return np.concatenate(keys), np.concatenate(kinds)


def near_pairs(key, row, n, kind, component, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of one entry (rows sorted by key, row) at distances begin..end - 1 that may be similar and are apart."""
    a, b = [], []
    for d in range(begin, end):
        if d >= len(key):
            break
        same = key[d:] == key[:-d]
        if not same.any():
            break
        x, y = np.minimum(n[d:], n[:-d]).astype(np.int64), np.maximum(n[d:], n[:-d]).astype(np.int64)
        ok = same & (100 * x >= NUMERATOR * y) & ~((kind[d:] == LIGHT) & (kind[:-d] == LIGHT))
        if component is not None:
            ok &= component[d:] != component[:-d]
        at = np.flatnonzero(ok)
        a.append(row[at])
        b.append(row[at + d])
    return (np.concatenate(a), np.concatenate(b)) if a else (row[:0], row[:0])


def parity(tokens: np.ndarray) -> np.ndarray:
    """The parities of a set: a power of two of bits, at least BITS for each token and 256 in all, in words of 64."""
    size = 1 << max(8, (BITS * len(tokens) - 1).bit_length())
    words, place = np.zeros(size // 64, U), tokens & U(size - 1)
    np.bitwise_xor.at(words, (place >> U(6)).astype(np.int64), U(1) << (place & U(63)))
    return words


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """The same parities in ``size`` words, not more than there are."""
    return np.bitwise_xor.reduce(words.reshape(-1, size), axis=0)


def may_differ(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Tokens that are in one of two similar sets alone, at most."""
    return n + m - 2 * -(-NUMERATOR * (n + m) // (100 + NUMERATOR))


def alike(a: np.ndarray, b: np.ndarray, n: np.ndarray, parities: list[np.ndarray]) -> np.ndarray:
    """Which pairs (a[i], b[i]) of rows have parities that similar sets can have; their sizes are ``n``."""
    width = np.array([len(p) for p in parities], np.int64)
    common, most = np.minimum(width[a], width[b]), may_differ(n[a], n[b])
    keep = np.zeros(len(a), bool)
    for size in np.unique(common):
        pairs = np.flatnonzero(common == size)
        rows = np.unique(np.concatenate([a[pairs], b[pairs]]))
        table = np.stack([folded(parities[r], int(size)) for r in rows])
        step = max(1, COMPARED // (8 * int(size)))
        for first in range(0, len(pairs), step):
            some = pairs[first:first + step]
            x, y = table[np.searchsorted(rows, a[some])], table[np.searchsorted(rows, b[some])]
            keep[some] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most[some]
    return keep


def places(rows: int, own: int, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places x < y < ``rows`` at distances begin..end - 1 with x < ``own``, in parts of some 65,536."""
    own = min(own, rows - begin)
    step = max(1, (1 << 16) // max(1, min(end, rows) - begin))
    for first in range(0, own, step):
        x = np.arange(first, min(first + step, own))
        count = np.minimum(x + end, rows) - x - begin
        before = np.cumsum(count) - count
        yield np.repeat(x, count), np.arange(count.sum()) + np.repeat(x + begin - before, count)


def _paired(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (a, b) with the columns of both rows of ``of`` (row_id, ...)."""
    for side in ("a", "b"):
        pairs = pairs.join(of.select(F.col("row_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs.select("a", "b", *[f"{c}_{side}" for side in ("a", "b") for c in columns])


def possible(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """The distinct ``pairs`` (a, b) whose parities (in ``table``) do not show that the sets are not similar."""
    def may_be(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(batch)
            sizes = np.concatenate([batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b")])
            parities = [np.frombuffer(x, U) for c in ("bits_a", "bits_b") for x in batch.column(c).to_pylist()]
            keep = alike(np.arange(k), np.arange(k) + k, sizes, parities)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(_paired(pairs.distinct(), table, "n", "bits"), may_be, "a long, b long")


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose sets, made from the texts again, are similar token by token."""
    left = materialize(pairs, "pairs")
    ids = left.select(F.col("a").alias("row_id")).unionAll(left.select(F.col("b").alias("row_id"))).distinct()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingles(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(sets, pa.binary())], ["row_id", "tokens"])

    read, _ = with_ids(rows.select("row_id", "text"), ids)
    sets = map_batches(read, tokens, "row_id long, tokens binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.sort(np.concatenate([x, y]))
                keep.append(similar(int((both[1:] == both[:-1]).sum()), len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(_paired(left, sets, "tokens"), compare, "a long, b long")


def _further(begin: int, end: int):
    """Pairs of members of an entry, the first among the SPAN of a block, at these distances, in two components and alike."""
    def pairs(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending")])
        place, row, n, kind, component = (table[c].to_numpy() for c in ("place", "row_id", "n", "kind", "component"))
        n = n.astype(np.int64)
        parities = [np.frombuffer(x, U) for x in table["bits"].to_pylist()]
        own = int(np.searchsorted(place, (int(table["block"][0].as_py()) + 1) * SPAN))
        a, b = [row[:0]], [row[:0]]
        for x, y in places(len(row), own, begin, end):
            ok = (component[x] != component[y]) & ~((kind[x] == LIGHT) & (kind[y] == LIGHT)) & \
                (100 * np.minimum(n[x], n[y]) >= NUMERATOR * np.maximum(n[x], n[y]))
            x, y = x[ok], y[ok]
            ok = alike(x, y, n, parities)
            a.append(row[x[ok]])
            b.append(row[y[ok]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})
    return pairs


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (doc_id, text; other columns are not read).

    Two documents link if their sets of shingles have a similarity of NUMERATOR / 100 or more; ``component_id`` is the
    smallest doc_id that links lead to, the own one included. A null or empty text, or one without words, has no shingles and
    links with nothing. Repeated rows are one document and give equal rows; see ``identified`` for rows of one doc_id and
    none (a component of rows without doc_id has none). An empty table gives an empty one.
    """
    all_rows, size, unique = identified(docs)
    named = row_components(all_rows if unique else all_rows.dropDuplicates(["row_id"]), size)
    if unique:
        return named.select(F.col("row_id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    ids = all_rows.select("row_id", "doc_id")
    first = ids.distinct().select(F.col("row_id").alias("component"), F.col("doc_id").alias("component_id"))
    return ids.join(named.join(first, "component"), "row_id").select("doc_id", "n_shingles", "component_id")


def row_components(rows: DataFrame, size: int) -> DataFrame:
    """``row_id, n_shingles, component`` (a row_id) of distinct ``rows`` (row_id, text) with ``size`` bytes of text."""
    spark = rows.sparkSession
    buckets = bucket_count(spark, size)
    often = spark.sparkContext.broadcast(frequent_tokens(rows, buckets))  # MOST tokens at most, 9 bytes each

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, power = often.value
        for batch in batches:
            n, one, two, keys, kinds, bits = [], [], [], [], [], []
            for s in shingles(batch.column("text")):
                cells = _cell(s, buckets)
                at = np.searchsorted(frequent, cells)
                inside, powers = np.flatnonzero(at < len(frequent)), np.zeros(len(s), np.uint8)
                same = inside[frequent[at[inside]] == cells[inside]]
                powers[same] = power[at[same]]
                key, kind = entries(s, powers) if len(s) else (s, np.zeros(0, np.uint8))
                n.append(len(s))
                one.append(mix(s, s).sum(dtype=U).astype(np.int64))
                two.append(mix(s, s, 1).sum(dtype=U).astype(np.int64))
                keys.append(key.tobytes())
                kinds.append(kind.tobytes())
                bits.append(parity(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), pa.array(n, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                 pa.array(keys, pa.binary()), pa.array(kinds, pa.binary()), pa.array(bits, pa.binary())],
                ["row_id", "n", "one", "two", "keys", "kinds", "bits"])

    table = materialize(map_batches(rows.select("row_id", "text"), indexed, "row_id long, n int, one long, two long, "
                                    "keys binary, kinds binary, bits binary"), "entries")
    # equal sets are one node, named by its smallest row; empty sets are alone
    nodes = table.filter("n > 0").groupBy("n", "one", "two").agg(F.min("row_id").alias("node"))
    nodes = materialize(nodes, "nodes")
    ids = nodes.select(F.col("node").alias("row_id"))
    firsts, _ = with_ids(table, ids)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(x, U) for x in batch.column("keys").to_pylist()]
            kinds = [np.frombuffer(x, np.uint8) for x in batch.column("kinds").to_pylist()]
            count = [len(k) for k in keys]
            key = np.concatenate([np.zeros(0, U), *keys])
            yield packed_batch(pack(bucket_of(mix(key, key), buckets), [
                key, np.repeat(batch.column("row_id").to_numpy(), count),
                np.repeat(batch.column("n").to_numpy(), count), np.concatenate([np.zeros(0, np.uint8), *kinds])]))

    def offered(table: pa.Table) -> pa.Table:
        """First pairs of every entry (key null), and the members of entries that have more."""
        columns = unpack(table["pack"].to_pylist(), _ENTRY_KINDS)
        order = np.lexsort((columns[1], columns[0]))
        key, row, n, kind = (c[order] for c in columns)
        again = new_group(key, row)  # rows that are there twice
        key, row, n, kind = key[again], row[again], n[again], kind[again]
        a, b = near_pairs(key, row, n, kind, None, 1, NEAR + 1)
        new = new_group(key)
        starts = np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else np.zeros(0, int)
        members = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if len(key) else np.zeros(0, int)
        large = members > NEAR + 1
        # of large entries all members are also offered to the first one, so that most components are stars at once
        low, high = np.minimum(n, n[starts]).astype(np.int64), np.maximum(n, n[starts]).astype(np.int64)
        star = large & (row != row[starts]) & (100 * low >= NUMERATOR * high)
        a, b = np.concatenate([a, row[starts][star]]), np.concatenate([b, row[star]])
        pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        none, zero = pa.nulls(len(pairs), pa.int64()), pa.nulls(len(pairs), pa.int32())
        return pa.concat_tables([
            pa.table({"key": none, "a": pairs[:, 0], "b": pairs[:, 1], "n": zero, "kind": zero, "place": zero}),
            pa.table({"key": key[large].astype(np.int64), "a": row[large], "b": pa.nulls(int(large.sum()), pa.int64()),
                      "n": n[large].astype(np.int32), "kind": kind[large].astype(np.int32),
                      "place": (np.arange(len(key)) - starts)[large].astype(np.int32)})])

    offers = materialize(map_groups(map_batches(firsts.select("row_id", "n", "keys", "kinds"), dealt, PACKS), "bucket",
                                    offered, "key long, a long, b long, n int, kind int, place int"), "offers")
    parities = table.select("row_id", "n", "bits")
    edges = materialize(verified(possible(offers.filter("key IS NULL").select("a", "b"), parities), rows), "edges")
    members = offers.filter("key IS NOT NULL").select("key", F.col("a").alias("row_id"), "n", "kind", "place")
    found = components(edges)
    begin, end = NEAR + 1, NEAR * GROWTH
    while True:
        # entries whose members are all connected by now are done, and so are those with no members this far apart
        known = members.join(found, "row_id", "left").withColumn("component", F.coalesce("component", "row_id"))
        left = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                        F.count("*").alias("m")).filter((F.col("low") < F.col("high")) & (F.col("m") > begin))
        known = materialize(known.join(left.select("key"), "key"), "members")
        if known.isEmpty():
            break
        members = known.drop("component")

        asked, _ = with_ids(parities.select("row_id", "bits"), known.select("row_id").distinct())
        back = F.greatest(F.col("place") - (end - 1), F.lit(0))
        blocks = F.sequence(F.floor(back / SPAN), F.floor(F.col("place") / SPAN))
        spread = known.join(asked, "row_id").withColumn("block", F.explode(blocks))
        pairs = map_groups(spread, ["key", "block"], _further(begin, end), "a long, b long").distinct()
        links = materialize(verified(pairs, rows), "edges")
        if not links.isEmpty():  # to the components so far, as stars
            stars = found.select(F.col("row_id").alias("a"), F.col("component").alias("b"))
            found = components(stars.unionAll(links))
        begin, end = end, end * GROWTH
    # back from nodes to rows
    named = table.select("row_id", "n", "one", "two").join(nodes, ["n", "one", "two"], "left").select(
        "row_id", "n", F.coalesce("node", "row_id").alias("node"))
    return named.join(found.select(F.col("row_id").alias("node"), "component"), "node", "left").select(
        "row_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "node").alias("component"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` (doc_id, text and any more columns) for each component, that of the smallest doc_id.

    Documents without shingles all stay; of rows that are there twice (doc_id and text) one stays, whichever.
    """
    rows, size, unique = identified(docs, rest=True)
    distinct = rows if unique else rows.dropDuplicates(["row_id"])
    kept = row_components(distinct.select("row_id", "text"), size).filter("row_id = component").select("row_id")
    return with_ids(distinct, materialize(kept, "kept"))[0].select("rest.*")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
