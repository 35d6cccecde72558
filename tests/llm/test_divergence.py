"""The audit of sources, against a plain version over all pairs and terms."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import words
from tests.llm.test_resampling import lower
from tidegrid.llm import divergence
from tidegrid.llm.divergence import audit, count_terms

SCHEMA = "text STRING, lang STRING, source STRING, n STRING, term INT, gid INT, rank INT"


def terms(text):
    out, word = [], ""
    for c in lower(text) + " ":
        if c.isascii() and not c.isalpha():
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def plain(rows, least=3, most=200):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", terms(text)
        groups[lang].add(source)
        n[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in docs[lang].items() if k >= least]

        def shares(counts):
            size = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // size for t in kept}
        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources - {s}]
            own = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", own)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found) if part == "pair" or i < most]
    return sorted(out)


def rows_of():
    rnd = random.Random(5)
    out = []
    for i in range(160):
        source = rnd.choice(["hot"] * 3 + ["a", "b", "Ü", "z z", "only", None])
        text = " ".join(rnd.choice(words(i % 7, 30, 25)) + rnd.choice(["", ",", " The", " the", "—x", "1y"]) for _ in range(25))
        out.append((text, rnd.choice(["en", "fr", None]), source))
    out += [(None, "en", "silent"), ("", "de", "x"), ("Wort", "de", "y"), ("The " * 9000, "en", "a"), (out[0])] + [out[3]] * 4
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, 2, 3) for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("side, bits, least, most", [(16, 15, 3, 200), (2, 7, 1, 5), (1, 6, 2, 200)])
def test_audit(spark, monkeypatch, side, bits, least, most):
    monkeypatch.setattr(divergence, "SIDE", side)
    monkeypatch.setattr(divergence, "CHUNK_BITS", bits)
    rows = rows_of()
    got = audit(frame(spark, rows), least, most)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows, least, most)


def test_empty_and_single(spark):
    assert audit(frame(spark, [])).collect() == []
    assert audit(frame(spark, [("a b", "en", "s")])).collect() == []  # one source, nothing kept
    none = audit(frame(spark, [(None, None, None), (None, None, "x")])).collect()
    assert sorted(map(tuple, none)) == [("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)]


def test_counts(spark):
    rows = rows_of()
    got = {tuple(r)[:3]: tuple(r)[3:] for r in count_terms(frame(spark, rows)).collect()}
    n, docs = Counter(), Counter()
    for text, lang, source in rows:
        found = [(lang or "", source or "", t) for t in terms(text)]
        n.update(found)
        docs.update(set(found))
        n[lang or "", source or "", None] += 0
    assert got == {k: (v, docs[k]) for k, v in n.items()}


def test_shares_of_large_counts(spark):
    n, size = [0, 10**6, 10**12, 4 * 10**15], [1, 3 * 10**9, 10**13, 9 * 10**15]
    want = [1 + 10**9 * (a + 1) // b for a, b in zip(n, size)]
    assert divergence._shares(np.array(n), np.array(size)).tolist() == want
    df = spark.createDataFrame(list(zip(n, size)), "n long, size long")
    assert [r[0] for r in df.select(divergence.share(df["n"], df["size"])).collect()] == want


def test_a_tile_in_small_steps(monkeypatch):
    rnd = random.Random(1)
    counts = {g: {t: rnd.choice([0, 0, 1, 1, 2, 9]) for t in range(200)} for g in range(4)}
    size = {g: sum(c.values()) + 200 for g, c in counts.items()}
    rows = []
    for g, own in counts.items():
        rows.append(("l", g, 2, None, 200, None, size[g]))
        sets = defaultdict(int)
        for t, n in own.items():
            if n:
                sets[n, t >> 6] |= 1 << (t & 63)
        rows += [("l", g, 2, w, n, b - (1 << 64) if b >> 63 else b, size[g]) for (n, w), b in sets.items()]
    rnd.shuffle(rows)
    table = pa.table(dict(zip(("lang", "gid", "side", "word", "n", "bits", "size"), map(list, zip(*rows)))))
    share = {g: [1 + 10**9 * (c + 1) // size[g] for c in own.values()] for g, own in counts.items()}
    want = {(a, b): sum((p - q) ** 2 // q for p, q in zip(share[a], share[b])) for a in share for b in share if a != b}
    for pairs in (1, 7, 1 << 20):
        monkeypatch.setattr(divergence, "PAIRS", pairs)
        got = divergence.tile(table).to_pylist()
        assert {(r["a"], r["b"]): r["value"] for r in got} == want
