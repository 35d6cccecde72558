"""Importance resampling, against a plain version over all rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import varied, words
from tidegrid.llm.arrays import blocks
from tidegrid.llm.ranks import numbered
from tidegrid.llm.resampling import KEY, bucket_counts, gains, kth_key, resample
from tidegrid.llm.terms import LETTERS, LETTERS_AND_DIGITS, Terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_features(text, longest=1, buckets=10_000):
    w = TERM.findall(lower(text))
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, percent=10, least=20, longest=1, buckets=10_000):
    source = [plain_features(t, longest, buckets) for _, t in docs]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for f in source:
        np.add.at(s, f, 1)
    for text in target:
        np.add.at(t, plain_features(text, longest, buckets), 1)
    gain = [math.floor(1000 * math.log((y + 1) * (s.sum() + buckets) / ((x + 1) * (t.sum() + buckets)))) for x, y in zip(s, t)]
    rows = []
    for (d, _), f in zip(docs, source):
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[:len(able) * percent // 100]
    return rows, drawn


ODD = [(None, " ".join(words(8, 40))), (None, None), (5, " ".join(words(9, 40))), (5, " ".join(words(9, 40))),
       (6, " ".join(words(10, 40))), (600, "\x00x9Zß_中—文 a\tb" * 12), (601, "long" * 40_000 + " tail"), (602, "_ . ! @[`{~")]


@pytest.mark.parametrize("percent, longest, buckets", [(10, 1, 10_000), (60, 2, 37), (100, 3, 500)])
def test_resample(spark, frame, percent, longest, buckets):
    docs = [*varied(), *ODD]
    target = [None, "", *(" ".join(words(40 + i, 60)) for i in range(5))]
    items = spark.createDataFrame([(t, 1) for t in target], "text STRING, bucket INT")
    got = [tuple(r) for r in resample(frame(docs), items, percent, longest=longest, buckets=buckets).collect()]
    rows, drawn = plain(docs, target, percent, longest=longest, buckets=buckets)
    assert sorted((r[:4] for r in got), key=str) == sorted(rows, key=str)
    winners = sorted((r for r in got if r[4] is not None), key=lambda r: r[4])
    assert [r[4] for r in winners] == list(range(1, len(drawn) + 1))
    assert [(r[0], r[3]) for r in winners] == [(r[0], r[3]) for r in drawn]


def test_nothing_to_draw(spark, frame):
    items = spark.createDataFrame([], "text STRING")
    assert resample(frame([]), items).collect() == []
    got = resample(frame([(1, "a b"), (2, None)]), items).collect()
    assert [(r["doc_id"], r["n_features"], r["rank"]) for r in sorted(got)] == [(1, 2, None), (2, 0, None)]
    assert resample(frame([(i, "a " * 30) for i in range(9)]), items).filter("rank IS NOT NULL").count() == 0  # floor(0.9)


def test_quickselect_finds_every_key(spark):
    rnd = random.Random(4)
    keys = [(rnd.randrange(4), rnd.randrange(2), rnd.randrange(3), rnd.randrange(2), i) for i in range(60)]
    keyed = spark.createDataFrame(keys, ", ".join(f"{c} long" for c in KEY)).repartition(5).cache()
    for k in (1, 2, 17, 59, 60):
        assert kth_key(keyed, k, pivots=3) == sorted(keys)[k - 1]
    assert kth_key(keyed, 61) is None
    assert [tuple(r)[:5] for r in numbered(keyed, KEY, "rank", "all").orderBy("rank").collect()] == sorted(keys)


def test_counts_and_gains(frame):
    docs = varied()
    want = np.zeros(50, np.int64)
    for _, t in docs:
        np.add.at(want, plain_features(t, 1, 50), 1)
    assert bucket_counts(frame(docs), 1, 50).tolist() == want.tolist()
    assert gains(np.array([1, 0]), np.array([0, 3])).tolist() == [math.floor(1000 * math.log(1 * 3 / (2 * 5))),
                                                                 math.floor(1000 * math.log(4 * 3 / (1 * 5)))]


@pytest.mark.parametrize("inside, pattern", [(LETTERS_AND_DIGITS, TERM), (LETTERS, re.compile(r"[^\x00-\x60\x7B-\x7F]+"))])
def test_terms_are_those_of_the_pattern(inside, pattern):
    texts = [t for _, t in varied()] + [t for _, t in ODD]
    for first, data, offsets in blocks(pa.array(texts), 3000):
        terms = Terms(data, offsets, inside)
        own, count = terms.texts().to_pylist(), terms.count.tolist()
        crc, _ = terms.checksums()
        want = [pattern.findall(lower(t)) for t in texts[first:first + len(count)]]
        assert count == [len(w) for w in want] and own == [w for ws in want for w in ws]
        assert crc.tolist() == [zlib.crc32(w.encode()) for w in own]
