import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tests.llm.conftest import varied, words
from tidegrid.llm import jaccard_join, suffix_dedup, window_dedup

BYTES = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
WORDS = ("n_words", "n_removed", "kept_sha256")


def found(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_bytes_equal_brute_force(frame):
    docs = varied()
    assert found(suffix_dedup.remove_repeats(frame(docs), digest=True), *BYTES) == brute.repeated_bytes(docs)


def test_words_equal_brute_force(frame):
    docs = varied()
    assert found(window_dedup.remove_repeats(frame(docs), digest=True), *WORDS) == brute.repeated_windows(docs)


def test_components_equal_brute_force(frame):
    docs = varied()
    got = found(jaccard_join.jaccard_components(frame(docs)), "n_shingles", "component_id")
    assert got == brute.components(docs)


def test_many_copies_and_a_chain(frame):
    """A group larger than an entry's first round, members that only meet through others, and lines that all share."""
    base, line = words(5, 60), words(6, 25)
    docs = [(i, " ".join([*base[:40], *words(1000 + i // 2, 3), *base[40:]])) for i in range(90)]
    docs += [(100 + i, " ".join([*line, *words(2000 + i, 40)])) for i in range(60)]
    docs += [(200 + i, " ".join(words(7, 400)[8 * i:8 * i + 120])) for i in range(20)]
    got = found(jaccard_join.jaccard_components(frame(docs)), "n_shingles", "component_id")
    want = brute.components(docs)
    assert got == want and len({c for _, c in want.values()}) < 90


def test_copies_that_hardly_link(frame, monkeypatch):
    """A group of copies about as similar as the limit, of three lengths, whose entries are split into many blocks."""
    monkeypatch.setattr(jaccard_join, "SPAN", 8)
    base, rnd = words(9, 220), random.Random(9)
    docs = [(i, " ".join(f"new{i}x{j}" if rnd.random() < 0.011 else w for j, w in enumerate(base[:120 + 50 * (i % 3)])))
            for i in range(240)]
    got = found(jaccard_join.jaccard_components(frame(docs)), "n_shingles", "component_id")
    want = brute.components(docs)
    assert got == want and len({c for _, c in want.values()}) > 1


def test_parities_lose_no_similar_pair_and_few_others_pass():
    rnd = np.random.default_rng(5)
    sets = []
    for n in (1, 2, 7, 30, 31, 32, 33, 260, 1000, 1025):
        base = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        for share in (0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4):
            gone = rnd.random(len(base)) < share
            sets.append(np.unique(np.concatenate([base[~gone], rnd.integers(0, 1 << 63, int(gone.sum()), dtype=np.uint64)])))
    a, b = np.triu_indices(len(sets), 1)
    sizes = np.array([len(s) for s in sets], np.int64)
    ok = 100 * np.minimum(sizes[a], sizes[b]) >= 75 * np.maximum(sizes[a], sizes[b])
    a, b = a[ok], b[ok]
    shared = np.array([len(np.intersect1d(sets[x], sets[y])) for x, y in zip(a, b)])
    ratio = 100 * shared / (sizes[a] + sizes[b] - shared)
    kept = jaccard_join.alike(a, b, sizes, [jaccard_join.parity(s) for s in sets])
    assert kept[ratio >= 75].all() and (ratio >= 75).sum() > 30
    large = np.minimum(sizes[a], sizes[b]) >= 200
    assert not kept[large & (ratio < 70)].any() and (large & (ratio < 70)).sum() > 20


@pytest.mark.parametrize("rows, own, begin, end", [(0, 5, 1, 3), (1, 1, 1, 9), (30, 30, 5, 64), (30, 7, 2, 6), (900, 800, 64, 900)])
def test_places_are_all_pairs_of_these_distances(rows, own, begin, end):
    got = [p for x, y in jaccard_join.places(rows, own, begin, end) for p in zip(x.tolist(), y.tolist(), strict=True)]
    assert got == [(x, y) for x in range(min(own, rows)) for y in range(x + begin, min(x + end, rows))]


def test_rarer_tokens_come_first():
    tokens, powers = np.arange(8, dtype=np.uint64), np.array([4, 0, 9, 3, 3, 0, 5, 4], np.uint8)
    keys, kinds = jaccard_join.entries(tokens, powers)  # a prefix of three, extended by one: two rare, then 3 and 4
    assert keys[:2].tolist() == [1, 5] and len(keys) == 4 and kinds.tolist() == [0, 0, 0, jaccard_join.LIGHT]
    assert keys[2] == jaccard_join.mix(tokens[3:4], tokens[4:5])[0]


@pytest.mark.parametrize("remove, columns, plain", [(suffix_dedup.remove_repeats, BYTES, brute.repeated_bytes),
                                                    (window_dedup.remove_repeats, WORDS, brute.repeated_windows)])
def test_repeated_and_missing_ids(frame, remove, columns, plain):
    a, b = " ".join(words(1, 40)), " ".join(words(2, 40))
    rows = [(5, a), (5, a), (5, b), (None, a), (None, b), (3, None), (3, None)]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, *[r[c] for c in columns]) for r in remove(frame(rows), True).collect())
    first = plain([(1, a), (2, b), (3, a), (4, b), (5, None)])
    assert got == sorted([(False, 5, *first[1])] * 2 + [(False, 5, *first[2])] + [(True, 0, *first[3]), (True, 0, *first[4])]
                         + [(False, 3, *first[5])] * 2)


def test_components_of_repeated_and_missing_ids(frame):
    a, b = " ".join(words(1, 40)), " ".join(words(2, 40))
    got = jaccard_join.jaccard_components(frame([(5, a), (5, a), (7, a), (None, a), (5, b), (None, b), (None, "")]))
    assert sorted(((r["doc_id"], r["component_id"]) for r in got.collect()), key=str) == sorted(
        [(5, 5), (5, 5), (7, 5), (None, 5), (5, 5), (None, 5), (None, None)], key=str)


def test_empty_tables(frame):
    assert suffix_dedup.remove_repeats(frame([])).collect() == []
    assert window_dedup.remove_repeats(frame([])).collect() == []
    assert jaccard_join.jaccard_components(frame([])).collect() == []


def test_long_text_across_pieces(frame):
    """A text longer than what is worked on at once, repeated inside itself and in another."""
    long = " ".join(words(8, 60_000, 10**6))
    docs = [(1, long), (2, "front " + long[200_000:300_000]), (3, long[100_000:100_300] + " and " + long[:50])]
    got = found(suffix_dedup.remove_repeats(frame(docs), digest=True), *BYTES)
    assert got == brute.repeated_bytes(docs)


def test_what_is_left(frame):
    text = " ".join(words(1, 40))
    df = frame([(1, text), (2, text + " and more"), (3, "é" * 70)])
    left = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(df).collect()}
    assert left == {1: text.encode(), 2: b" and more", 3: ("é" * 70).encode()[:0] + left[3]}
    kept = {r["doc_id"]: r["kept"] for r in window_dedup.remove_repeats(df).collect()}
    assert kept == {1: text, 2: "and more", 3: "é" * 70}


def test_a_name_opened_in_one_batch_opens_it_in_the_others(spark):
    """Many contexts of one name in one batch, and a copy of the one that is sent on in an earlier row of another batch."""
    rnd = random.Random(4)

    def text(n):
        return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    many = text(50_000)
    at = int(suffix_dedup.names(np.frombuffer(many.encode(), np.uint8))[0][:-36].argmin())
    name, before, after = many[at:at + 36], text(20), text(64)  # the smallest name is the anchor of all strings around it
    batch = [(10 + i, text(64) + before + name + after) for i in range(suffix_dedup.MANY + 4)]
    columns = suffix_dedup.anchors(pa.array([t for _, t in batch]), np.array([d for d, _ in batch]))
    sent = [int(d) for d, flag in zip(*[suffix_dedup.sort_anchors(columns, False)[0][c] for c in (2, 5)], strict=True) if flag]
    assert len(sent) == 1 and sent[0] > 10
    docs = [(1, dict(batch)[sent[0]]), *[(-i, text(150)) for i in range(1, len(batch))], *batch]
    two = spark.createDataFrame(spark.sparkContext.parallelize(docs, 2), "doc_id BIGINT, text STRING")
    assert [len(p) for p in two.rdd.glom().collect()] == [len(batch)] * 2
    assert found(suffix_dedup.remove_repeats(two, digest=True), *BYTES) == brute.repeated_bytes(docs)
