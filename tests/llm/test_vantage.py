"""Vantage-point trees: a factor of one against brute force, larger ones by their recall."""

import math

import numpy as np
import pyarrow as pa
import pytest

from tidegrid.llm import vantage
from tidegrid.llm.vantage import Routes, Search, Tree, distance, matrix, nearest, on_sphere, op13_nearest_vectors

SMALL = "/root/testdata/sf0.01"


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(d, v and [x if x is None else float(x) for x in v], "q", 1, 0.5) for d, v in rows],
                                 f"vec_id LONG, embedding ARRAY<{kind}>, query STRING, shard INT, score DOUBLE").repartition(3)


def product(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def usable(rows):
    return sorted({(d, tuple(np.float32(v).tolist())) for d, v in rows if d is not None and v and all(
        x is not None and math.isfinite(x) for x in v) and any(v)})  # float32 holds all values of the doubles used here


def brute(rows, queries, k):
    rows, out = usable(rows), []
    for q, v in usable(queries):
        found = sorted({(-product(v, x), d) for d, x in rows if d != q})
        best = {}
        for s, d in found:  # a vec_id that has several vectors may come more than once
            best.setdefault((d, s), None)
        out += [(q, i + 1, d, -s) for i, (d, s) in enumerate(list(best)[:k])]
    return out


def mixed(n=260, dim=6):
    random = np.random.default_rng(3)
    centres = random.normal(size=(5, dim))
    x = (centres[random.integers(5, size=n)] + 0.2 * random.normal(size=(n, dim))) * random.choice([0.1, 1, 8], size=(n, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(1100 + i, [1.0, 0, 0, 0, 0, 0]) for i in range(30)]  # copies
    rows += [(2000 + i, np.eye(dim)[i % dim].tolist()) for i in range(30)]  # ties
    rows += [(3000, None), (3001, []), (3002, [0.0] * dim), (3003, [1.0, None, 0, 0, 0, 0]), (3020, [float("nan")] * dim),
             (3040, [float("inf"), 1, 1, 1, 1, 1]), (None, [1.0] * dim), (3060, [2.0, 1.0]), (3060, [2.0, 1.0]), (3080, [5.0])]
    return rows


@pytest.mark.parametrize("shard_rows, leaf_rows, k", [(8192, 256, 20), (40, 4, 7), (11, 1, 3)])
def test_a_factor_of_one_is_exact(spark, monkeypatch, shard_rows, leaf_rows, k):
    monkeypatch.setattr(vantage, "QUERY_ROWS", 5)
    rows = mixed()
    queries = [r for r in rows if r[0] is None or r[0] % 20 == 0]
    got = nearest(frame(spark, rows), frame(spark, queries), k, 1.0, shard_rows, leaf_rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, queries, k))


def test_few_rows_and_none(spark):
    none = frame(spark, [])
    one = frame(spark, [(20, [1.0, 2.0])])
    assert nearest(none, none).collect() == [] and nearest(one, one).collect() == [] and nearest(one, none).collect() == []
    two = frame(spark, [(20, [1.0, 2.0]), (21, [0.5, 0.0]), (22, [0.5, 0.0])], "double")
    assert [tuple(r) for r in nearest(two, one).orderBy("rank").collect()] == [(20, 1, 21, 0.5), (20, 2, 22, 0.5)]


def test_recall_of_the_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = [tuple(r) for r in op13_nearest_vectors(spark, SMALL).collect()]
    assert len(got) == len(want) == len({(r[0], r[1]) for r in got})
    scores = {(q, d): s for q, _, d, s in brute(rows, [r for r in rows if r[0] % 20 == 0], len(rows))}
    assert all(scores[q, d] == s for q, _, d, s in got)
    assert len({(r[0], r[2]) for r in got} & {(r[0], r[2]) for r in want}) >= 0.95 * len(want)


@pytest.mark.parametrize("spread, even", [(0.15, True), (0.15, False), (1.0, True)])
def test_a_tuned_factor_finds_nearly_all_and_skips_some(monkeypatch, spread, even):
    random = np.random.default_rng(1)
    centres = random.normal(size=(40, 16))
    x = centres[random.integers(40, size=6000)] + spread * random.normal(size=(6000, 16))
    if even:
        x /= np.sqrt((x**2).sum(1))[:, None]
    norm = float(np.sqrt((x**2).sum(1)).max())
    tree, ids = Tree.grow(on_sphere(x, norm), 64), np.arange(len(x))
    q = x[::100]
    points = vantage._queries(q)
    want = np.argsort(-(points[:, :-1] @ x.T), axis=1)[:, :10]
    seen = []
    leaf = Search.leaf
    monkeypatch.setattr(Search, "leaf", lambda self, at, act: (seen.append(len(at) * len(act)), leaf(self, at, act))[1])
    work, recall = [], []
    for factor in (1.0, vantage.tuned_factor(x[random.permutation(len(x))[:2000]], norm, 10, 21)):
        seen.clear()
        found = Search(tree, points, ids, 10, np.full(len(q), -1.1), factor)
        work.append(sum(seen) / len(q) / len(x))
        recall.append(np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found.at.tolist(), want.tolist())]))
    assert recall[0] == 1 and recall[1] >= 0.95 and work[1] <= work[0], (recall, work, factor)
    if even:
        assert work[1] < 0.9 * work[0], (recall, work, factor)


def test_routes_reach_all_that_is_near_enough():
    random = np.random.default_rng(2)
    x = on_sphere(random.normal(size=(500, 5)), 5.0)
    routes = Routes(x[:200], 16)
    home = routes.home(x)
    assert 8 <= routes.leaves <= 16 and set(home) <= set(range(routes.leaves))
    reach = np.full(50, 0.4)
    place, leaf = routes.all(x[:50], reach)
    visited = {(p, n) for p, n in zip(place.tolist(), leaf.tolist())}
    away = distance(x[:50] @ x.T)
    assert all((i, home[j]) in visited for i, j in zip(*np.nonzero(away <= 0.4)))
    assert len(visited) < 50 * routes.leaves
    assert Routes(np.ones((100, 3)), 8).leaves == 1  # nothing to tell apart


def test_shorter_vectors_get_zeros():
    column = pa.array([[1.0, 2.0], [], [3.0]], pa.list_(pa.float32()))
    assert matrix(column, 3).tolist() == [[1, 2, 0], [0, 0, 0], [3, 0, 0]]
    assert matrix(column.slice(2), 1).tolist() == [[3]]
