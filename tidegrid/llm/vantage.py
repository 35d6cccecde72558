"""Nearest neighbours by inner product: shards of vectors, each with a vantage-point tree.

A vector of norm r gets one more component, sqrt(M^2 - r^2), M being the largest norm: all then lie on one sphere, queries go
there with a zero in that place, and the largest inner product is the smallest distance. In a tree every node keeps one vector,
its vantage point, and deals the others by their distance to it. By the triangle inequality a query that is further than its
present radius from a half's range of distances has nothing to find there. With ``factor`` f a half is skipped already when it
is further than radius / f; a factor of 1 is an exact search.

The shards are the leaves of such a tree too, grown from a bounded sample and split by a hash where many vectors meet. A query
first searches the shard it belongs to; the radius it finds there decides which of the others it must visit.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.workers import map_batches, send_package
from tidegrid.session import materialize

#: How much earlier than the triangle inequality halves may be skipped: the largest of these that finds AIM of the neighbours
#: of TRIED vectors of the sample. Measured recall is in the README.
FACTORS, AIM, TRIED = (8.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.5, 1.0), 0.98, 200
NEAREST, EVERY = 20, 20
#: Vectors of a shard and of a tree's leaf; queries of one task; leaves of the tree that deals vectors to shards.
SHARD_ROWS, LEAF_ROWS, QUERY_ROWS, MOST_LEAVES = 8192, 256, 4096, 1024
#: Distinct vectors, by a hash of their number, that the dealing tree is grown from and the factor is tuned on, and the numbers
#: in them. They say where vectors are put and how early halves are skipped; every vector is in a tree.
SAMPLE_ROWS, SAMPLE_VALUES = 16_384, 1 << 21
#: Vectors kept beyond those asked for, and relative slack of comparisons, so that rounding decides nothing.
MORE, SLACK = 4, 1e-9


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A row of ``width`` doubles for each vector; shorter ones get zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    sizes, flat = np.diff(offsets), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    inside = np.arange(width) < sizes[:, None]
    out[inside] = flat[offsets[0]:offsets[-1]]
    return out


def on_sphere(x: np.ndarray, norm: float) -> np.ndarray:
    """The vectors on the unit sphere with one more component, for a largest norm of ``norm``."""
    rest = np.sqrt(np.maximum(0.0, norm**2 - (x**2).sum(1)))
    return np.concatenate([x, rest[:, None]], axis=1) / norm


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The inner products of rows, added up from the first component to the last."""
    total = np.zeros(np.broadcast_shapes(q.shape[:-1], x.shape[:-1]))
    for i in range(q.shape[-1]):
        total += q[..., i] * x[..., i]
    return total


@dataclass
class Tree:
    """Points in the order of the leaves; a node halves a range of places and keeps the range of distances of either half."""

    points: np.ndarray  # on the sphere
    order: np.ndarray
    nodes: list[tuple] = field(default_factory=list)  # begin, end, vantage (a place) or -1, four limits, two children

    @classmethod
    def grow(cls, points: np.ndarray, leaf_rows: int, seed: int = 1) -> Tree:
        tree, random = cls(points, np.arange(len(points))), np.random.default_rng(seed)
        spans: list[tuple[int, int, int]] = [(0, len(points), -1)]
        while spans:
            begin, end, mother = spans.pop()
            if mother >= 0:
                tree.nodes[mother] = (*tree.nodes[mother], len(tree.nodes))
            if end - begin <= max(leaf_rows, 1):
                tree.nodes.append((begin, end, -1))
                continue
            span = tree.order[begin:end]
            vantage = int(random.choice(span))
            d = distance(points[span] @ points[vantage])
            half = (end - begin) // 2
            by = np.argpartition(d, half)
            tree.order[begin:end] = span[by]
            near, far = d[by[:half]], d[by[half:]]
            tree.nodes.append((begin, end, vantage, near.min(), near.max(), far.min(), far.max()))
            spans += [(begin + half, end, len(tree.nodes) - 1), (begin, begin + half, len(tree.nodes) - 1)]  # near one first
        return tree


class Search:
    """The ``keep`` nearest points of a tree for many queries at once, which split up where their ways part."""

    def __init__(self, tree: Tree, queries: np.ndarray, ids: np.ndarray, keep: int, floor: np.ndarray, factor: float):
        self.tree, self.queries, self.ids, self.factor = tree, queries, ids, factor
        self.best = np.full((len(queries), keep), -np.inf)  # cosines, not sorted
        self.at = np.full((len(queries), keep), -1)
        self.floor = floor.copy()  # what a cosine must reach to count
        self.visit(0, np.arange(len(queries)))

    def visit(self, node: int, act: np.ndarray) -> None:
        if not len(act):
            return
        begin, end, vantage, *more = self.tree.nodes[node]
        if vantage < 0:
            self.leaf(self.tree.order[begin:end], act)
            return
        a, b, c, d, near, far = more
        away = distance(self.queries[act] @ self.tree.points[vantage])
        first = away <= (b + c) / 2
        low = {near: np.maximum(away - b, a - away), far: np.maximum(away - d, c - away)}
        for child, mine in ((near, first), (far, ~first), (far, first), (near, ~first)):
            radius = distance(self.floor[act])  # has shrunk since
            self.visit(child, act[mine & (low[child] * self.factor <= radius + SLACK)])

    def leaf(self, at: np.ndarray, act: np.ndarray) -> None:
        cosine = self.queries[act] @ self.tree.points[at].T
        some = (cosine >= self.floor[act][:, None]).any(1)
        act, cosine = act[some], cosine[some]
        keep = self.best.shape[1]
        value = np.concatenate([self.best[act], cosine], axis=1)
        value[value < self.floor[act][:, None]] = -np.inf
        place = np.concatenate([self.at[act], np.broadcast_to(at, cosine.shape)], axis=1)
        chosen = np.argpartition(-value, keep - 1, axis=1)[:, :keep]
        kth = np.take_along_axis(value, chosen, 1).min(1, initial=np.inf)
        for i in np.flatnonzero((value >= kth[:, None]).sum(1) > keep):  # ties at the end go to the smaller id
            if kth[i] > -np.inf:
                chosen[i] = np.lexsort((self.ids[place[i]], -value[i]))[:keep]
        self.best[act] = np.take_along_axis(value, chosen, 1)
        self.at[act] = np.take_along_axis(place, chosen, 1)
        self.floor[act] = np.maximum(self.floor[act], kth - SLACK)


class Routes:
    """The tree that deals vectors to leaves, as thresholds only: any vector falls on one side of each."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 2):
        self.nodes: list = []
        self.leaves = 0
        self._grow(sample, int(np.ceil(np.log2(max(leaves, 1)))), np.random.default_rng(seed))

    def _grow(self, points: np.ndarray, depth: int, random) -> int:
        own = len(self.nodes)
        d = None
        if depth and len(points) > 1:
            vantage = points[random.integers(len(points))]
            d = distance(points @ vantage)
            limit = float(np.median(d))
            inside = d <= limit
        if d is None or inside.all():
            self.nodes.append(self.leaves)
            self.leaves += 1
            return own
        self.nodes.append(None)
        near, far = self._grow(points[inside], depth - 1, random), self._grow(points[~inside], depth - 1, random)
        self.nodes[own] = (vantage, limit, near, far)
        return own

    def home(self, points: np.ndarray) -> np.ndarray:
        return self._walk(points, np.full(len(points), -1.0))[1]

    def all(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of points and the leaves each must visit, if it reaches so far over the limits (radius / factor)."""
        return self._walk(points, np.maximum(reach, 0.0))

    def _walk(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found: list[tuple[np.ndarray, int]] = []
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, act = todo.pop()
            if not isinstance(self.nodes[node], tuple):
                found.append((act, self.nodes[node]))
                continue
            vantage, limit, near, far = self.nodes[node]
            d = distance(points[act] @ vantage)
            todo.append((near, act[(d <= limit) | (d - limit <= reach[act] + SLACK * (reach[act] >= 0))]))
            todo.append((far, act[(d > limit) | (limit - d <= reach[act] + SLACK * (reach[act] >= 0))]))
        place = np.concatenate([a for a, _ in found])
        leaf = np.concatenate([np.full(len(a), x) for a, x in found])
        order = np.argsort(place, kind="stable")
        return place[order], leaf[order]


def tuned_factor(sample: np.ndarray, norm: float, k: int, leaf_rows: int) -> float:
    """The largest of FACTORS that finds AIM of the ``k`` nearest of TRIED vectors in a tree over ``sample``."""
    if len(sample) < 2:
        return 1.0
    q = sample[:TRIED]
    points = _queries(q)
    cosine = points[:, :-1] @ sample.T / norm
    k = min(k, len(sample))
    least = np.partition(cosine, len(sample) - k, axis=1)[:, len(sample) - k]  # what the k-th reaches
    tree, ids = Tree.grow(on_sphere(sample, norm), leaf_rows), np.arange(len(sample))
    for factor in FACTORS:
        found = Search(tree, points, ids, k, np.full(len(q), -1.0 - SLACK), factor)
        if (found.best >= least[:, None] - SLACK).mean() >= AIM:
            return factor
    return 1.0


def _queries(q: np.ndarray) -> np.ndarray:
    """Queries on the sphere."""
    return np.concatenate([q / np.sqrt((q**2).sum(1))[:, None], np.zeros((len(q), 1))], axis=1)


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, vec`` of the rows that take part: an id, and finite components, not all zero."""
    element = vectors.schema[vector].dataType.elementType
    kind = "float" if isinstance(element, T.FloatType) else "double"
    read = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast(f"array<{kind}>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return read.filter("vec_id IS NOT NULL AND vec IS NOT NULL").filter(finite & F.exists("vec", lambda x: x != 0))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """``key, vec, ids`` for each different vector: its ``most`` smallest ids, which are all that can be among so many nearest.

    Repeats of a row are dropped and ids ranked before the shuffle as far as a task sees them, so copies do not gather.
    """
    order = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.groupBy("vec", "vec_id").agg(F.lit(1)).select("vec", "vec_id").withColumn("nth", F.row_number().over(order))
    found = few.filter(F.col("nth") <= most).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return found.withColumn("key", F.monotonically_increasing_id())


def stored_tree(x: np.ndarray, ids: pa.ListArray, norm: float, leaf_rows: int) -> bytes:
    tree = Tree.grow(on_sphere(x, norm), leaf_rows)
    nodes = np.array([(*n, *[0] * (9 - len(n))) for n in tree.nodes], np.float64).reshape(-1, 9)
    out = io.BytesIO()
    np.savez(out, x=x, order=tree.order, nodes=nodes, ids=ids.values.to_numpy(), offsets=ids.offsets.to_numpy())
    return out.getvalue()


def loaded_tree(stored: bytes, norm: float) -> tuple[Tree, np.ndarray, np.ndarray, np.ndarray]:
    """The tree, the vectors as they came, all ids, and where each vector's begin."""
    found = np.load(io.BytesIO(stored))
    nodes = [(int(n[0]), int(n[1]), int(n[2]), *n[3:7], int(n[7]), int(n[8])) if n[2] >= 0 else (int(n[0]), int(n[1]), -1)
             for n in found["nodes"]]
    return Tree(on_sphere(found["x"], norm), found["order"], nodes), found["x"], found["ids"], found["offsets"]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, factor: float | None = None, shard_rows: int = SHARD_ROWS,
            leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``vectors`` with the largest inner product with each of ``queries``.

    Both tables need vec_id and embedding (an array of numbers); other columns are not read. Nearest first, ties to the smaller
    vec_id; score is the inner product in doubles, added up in order. Rows without an id and vectors that are null, empty, zero
    or hold null or non-finite components take no part on either side. Shorter vectors count as if zeros followed. Rows equal
    in id and vector are one; rows of the query's vec_id are never its neighbours. With fewer candidates than ``k`` a query gets
    those that are found, with none no row; empty tables give an empty one.

    A factor of 1 finds the nearest themselves; a larger one skips more and may miss some. Without one it is tuned on a bounded
    sample, in a tree as deep as a vector's way through the shards' tree and its own would be. Every vector is in a tree.
    """
    spark, keep = vectors.sparkSession, k + 1  # the query itself may be among them
    table = materialize(distinct_vectors(usable(vectors), keep), "vectors")
    double = F.transform("vec", lambda x: x.cast("double"))
    square = F.aggregate(double, F.lit(0.0), lambda a, x: a + x * x)
    rows, width, norm2 = table.agg(F.count("*"), F.max(F.size("vec")), F.max(square)).first()
    asked = usable(queries)
    keys = materialize(asked.select("vec").distinct().withColumn("query", F.monotonically_increasing_id()), "query-vectors")
    asks = asked.join(keys, "vec").select(F.col("vec_id").alias("query_id"), "query").distinct()
    width = max(width or 0, keys.agg(F.max(F.size("vec"))).first()[0] or 0)
    norm = float(norm2 or 1.0) ** 0.5 * (1 + 1e-12)

    most = max(min(SAMPLE_ROWS, SAMPLE_VALUES // max(width, 1)), 64)
    drawn = table.orderBy(F.xxhash64("key", F.lit(5))).select("vec").limit(most).toArrow()
    sample = matrix(drawn["vec"], width) if rows else np.zeros((0, width))
    routes = Routes(on_sphere(sample, norm), min(-(-rows // shard_rows), MOST_LEAVES))
    if factor is None:
        factor = tuned_factor(sample, norm, keep, max(8, leaf_rows * len(sample) // max(rows, 1)))

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = routes.home(on_sphere(matrix(batch.column("vec"), width), norm))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], [*batch.schema.names, "leaf"])

    vec = table.schema["vec"].dataType.simpleString()
    dealt = materialize(map_batches(table.select("key", "ids", "vec"), to_leaf,
                                    f"key long, ids array<long>, vec {vec}, leaf int"), "dealt-vectors")
    sizes = {r["leaf"]: r["n"] for r in dealt.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # MOST_LEAVES at most
    parts = {leaf: -(-n // shard_rows) for leaf, n in sizes.items()}
    # number of a leaf's first shard, and how many it has
    begins = dict(zip(sorted(parts), np.cumsum([0] + [parts[x] for x in sorted(parts)]).tolist()))
    shard_of = spark.createDataFrame([(x, begins[x], n) for x, n in parts.items()], "leaf int, begin int, parts int")

    def build(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks().sort_by("key")
        ids = shard["ids"].combine_chunks()
        stored = stored_tree(matrix(shard["vec"], width), ids, norm, leaf_rows)
        return pa.table({"shard": shard["shard"][:1], "tree": pa.array([stored], pa.binary())})

    send_package(spark)
    index = (dealt.join(F.broadcast(shard_of), "leaf")
             .withColumn("shard", (F.col("begin") + F.pmod(F.xxhash64("key"), "parts")).cast("int"))
             .select("shard", "key", "ids", "vec").groupBy("shard").applyInArrow(build, "shard int, tree binary"))
    index = materialize(index, "vantage-trees")
    to_shards = (routes, {x: (begins[x], n) for x, n in parts.items()}, width, norm, factor)

    first = materialize(_searched(index, _sent(keys, to_shards), width, norm, keep, factor), "home-neighbours")
    bounds = first.select("query", "home", F.when(F.size("scores") >= keep, F.element_at("scores", keep)).alias("bound"))
    rest = _searched(index, _sent(keys.join(bounds, "query", "left"), to_shards, False), width, norm, keep, factor)
    found = first.select("query", "ids", "scores").unionByName(rest.select("query", "ids", "scores"))
    pair = found.select("query", F.explode(F.arrays_zip("ids", "scores")).alias("x"))
    pair = pair.select("query", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    order = [F.desc("score"), "vec_id"]
    best = (pair.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
            .filter(F.col("nth") <= keep).drop("nth"))
    ranks = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return (asks.join(best, "query").filter("query_id <> vec_id").withColumn("rank", ranks).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _sent(keys: DataFrame, to_shards, home: bool = True) -> DataFrame:
    """``query, vec, bound, shard``: every query with its own shard, or with all others that its bound lets it reach."""
    routes, shards, width, norm, factor = to_shards
    vec = keys.schema["vec"].dataType.simpleString()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column("vec"), width)
            size, points = np.sqrt((q**2).sum(1)), _queries(q)
            number = batch.column("query").to_numpy().astype(np.int64)
            if home:
                bound = np.full(len(q), np.nan)
                place, leaf = np.arange(len(q)), routes.home(points)
            else:
                bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)
                cosine = np.where(np.isnan(bound), -1.0, bound / (norm * size))
                place, leaf = routes.all(points, distance(cosine) / factor)
            begin, parts = (np.array([shards.get(x, (0, 0))[i] for x in leaf.tolist()], np.int64) for i in (0, 1))
            if home:  # one of the leaf's shards
                place, shard = place[parts > 0], (begin + number % np.maximum(parts, 1))[parts > 0]
            else:
                shard = np.repeat(begin, parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                place = np.repeat(place, parts)
                been = batch.column("home").fill_null(-1).to_numpy(zero_copy_only=False)[place]
                place, shard = place[shard != been], shard[shard != been]
            for at in range(0, len(place), 1 << 14):
                rows = pa.array(place[at:at + (1 << 14)])
                own = pa.array(bound[place[at:at + (1 << 14)]], from_pandas=True)
                yield pa.RecordBatch.from_arrays([batch.column("query").take(rows), batch.column("vec").take(rows), own,
                                                  pa.array(shard[at:at + (1 << 14)].astype(np.int32))],
                                                 ["query", "vec", "bound", "shard"])

    return map_batches(keys, send, f"query long, vec {vec}, bound double, shard int")


def _searched(index: DataFrame, sent: DataFrame, width: int, norm: float, keep: int, factor: float) -> DataFrame:
    """``query, home, ids, scores``: what each query finds in each shard it is sent to, best first, ``keep`` ids at most."""
    sent = materialize(sent, "sent-queries")
    loads = [(r["shard"], -(-r["n"] // QUERY_ROWS)) for r in sent.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    blocks = index.sparkSession.createDataFrame(loads, "shard int, blocks int")  # a row for each shard
    asked = (sent.join(F.broadcast(blocks), "shard").withColumn("block", F.pmod(F.xxhash64("query"), "blocks").cast("int"))
             .drop("blocks"))
    trees = (index.join(F.broadcast(blocks), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .drop("blocks"))

    def search(tree: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "home": [], "ids": [], "scores": []}
        if len(tree) and len(queries):
            grown, x, ids, offsets = loaded_tree(tree["tree"][0].as_py(), norm)
            q = matrix(queries["vec"], width)
            size, points = np.sqrt((q**2).sum(1)), _queries(q)
            bound = queries["bound"].to_numpy().astype(np.float64)
            floor = np.where(np.isnan(bound), -1.0, bound / (norm * size)) - SLACK
            found = Search(grown, points, ids[offsets[:-1]], keep + MORE, floor, factor)
            shard = tree["shard"][0].as_py()
            for i, query in enumerate(queries["query"].to_pylist()):
                at = found.at[i][found.best[i] > -np.inf]
                score = scores(q[i], x[at])
                count = np.diff(offsets)[at]
                own = np.concatenate([ids[offsets[a]:offsets[a + 1]] for a in at.tolist()] or [ids[:0]])
                score = np.repeat(score, count)
                order = np.lexsort((own, -score))[:keep]
                out["query"].append(query)
                out["home"].append(shard)
                out["ids"].append(own[order])
                out["scores"].append(score[order])
        return pa.table({"query": pa.array(out["query"], pa.int64()), "home": pa.array(out["home"], pa.int32()),
                         "ids": pa.array(out["ids"], pa.list_(pa.int64())),
                         "scores": pa.array(out["scores"], pa.list_(pa.float64()))})

    return (trees.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
            .applyInArrow(search, "query long, home int, ids array<long>, scores array<double>"))


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
