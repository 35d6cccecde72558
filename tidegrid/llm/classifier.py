"""A quality classifier: naive Bayes features, linear support vectors.

Features are indicators of n-grams: bytes by three, words by one and two, and runs of equal words, hashed into ``SIZE`` places.
Each is scaled by its log-count ratio between the classes and each text to length one; a linear model with hinge loss is
fitted to them by dual coordinate descent, and its margin is turned into a probability by a logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.arrays import U, Words, blocks, run_hashes
from tidegrid.llm.workers import map_batches, map_groups, texts_of

BITS = 16
SIZE = 1 << BITS
#: The first places are kept for runs of equal words: two, three, five and nine of them.
RUNS = (1, 2, 4, 8)
BLOCK = 1 << 18
#: Labelled rows that the model is fitted on, of each class at most; chosen by a hash of doc_id.
MOST_ROWS = 3000
_M = U(0x9E3779B97F4A7C15)


def indicators(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``SIZE`` truth values for each text of a block."""
    rows = len(offsets) - 1
    found = np.zeros((rows, SIZE), bool)
    flat = found.reshape(-1)
    row = np.repeat(np.arange(rows) * SIZE, np.diff(offsets))
    if len(data) > 2:
        three = data[:-2].astype(U) << U(16) | data[1:-1].astype(U) << U(8) | data[2:].astype(U)
        inside = row[:-2] == row[2:]
        flat[row[:-2][inside] + _place(three[inside])] = True
    words = Words(data, offsets)
    h, base = words.hashes(), words.row * SIZE
    flat[base + _place(h)] = True
    if len(h) > 1:
        same_row = words.row[1:] == words.row[:-1]
        two = run_hashes(h, 2)[:-1]
        flat[base[:-1][same_row] + _place(two[same_row])] = True
        equal, done = (h[1:] == h[:-1]) & same_row, 1
        for place, run in enumerate(RUNS):
            while done < run:  # runs double
                equal = equal[:-done] & equal[done:] if len(equal) > done else equal[:0]
                done *= 2
            flat[base[:len(equal)][equal] + place] = True
    return found


def _place(h: np.ndarray) -> np.ndarray:
    """A place after those of the runs."""
    return ((h * _M >> U(64 - BITS)) % U(SIZE - len(RUNS))).astype(np.int64) + len(RUNS)


@dataclass(frozen=True)
class Model:
    """The weight of each place, the square of its scale, and the logistic curve of the margin."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> np.ndarray:
        x = found.astype(np.float32)
        margin = (x @ self.weight) / np.sqrt(np.maximum(x @ self.square, 1e-12)) + self.bias
        return 1 / (1 + np.exp(-(self.slope * margin.astype(np.float64) + self.shift)))


def fit(texts: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> Model:
    """Fit to the places found in each text. With one class only, every score is that class's."""
    good = labels == 1
    if good.all() or not good.any():
        sure = 4.0 if good.any() else -4.0
        return Model(np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0.0, 0.0, sure)
    count = {c: np.ones(SIZE) for c in (True, False)}
    for places, label in zip(texts, good, strict=True):
        count[bool(label)][places] += 1
    ratio = np.log((count[True] / count[True].sum()) / (count[False] / count[False].sum()))
    rows = [(p, ratio[p] / max(np.linalg.norm(ratio[p]), 1e-6)) for p in texts]
    y = np.where(good, 1.0, -1.0)
    limit = np.where(good, cost * len(y) / (2 * good.sum()), cost * len(y) / (2 * (~good).sum()))
    weight, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(y))
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in random.permutation(len(y)):
            places, values = rows[i]
            slope = y[i] * (weight[places] @ values + bias) - 1
            new = min(max(alpha[i] - slope / (values @ values + 1), 0.0), limit[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weight[places] += step * values
                bias += step
                alpha[i] = new
    margin = np.array([weight[p] @ v for p, v in rows]) + bias
    slope, shift = _logistic(margin, good)
    return Model((weight * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias, slope, shift)


def _logistic(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """The curve of greatest likelihood for smoothed targets, the classes weighing the same; Newton's method."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(good, 0.5 / n1, 0.5 / n0)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        g = np.array([(weight * (p - target) * margin).sum() + 1e-4 * a, (weight * (p - target)).sum()])
        w = weight * p * (1 - p)
        hessian = np.array([[(w * margin**2).sum() + 1e-4, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(hessian, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(max(a, 0.0)), float(b)


def train(docs: DataFrame, labels: DataFrame, label: str, most_rows: int = MOST_ROWS) -> Model:
    """Fit on the labelled rows of ``labels`` (doc_id, ``label`` 0 or 1) that have a text in ``docs`` (doc_id, text).

    At most ``most_rows`` of each class, those of the smallest hash of doc_id, so the choice does not depend on order or
    partitions. Their places are found where the texts are; one task fits the model. Without labels every score is 0.5.
    A doc_id with both labels counts as 1; labels that are null or neither 0 nor 1, and rows without doc_id or text, are left out.
    The bound is one of doc_ids: a doc_id that ``docs`` has several times is fitted as often.
    """
    named = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
    named = named.filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id", F.lit(3)), F.col("doc_id")]
    # a bound of 2 * most_rows ids
    chosen = named.filter("label = 1").orderBy(*order).limit(most_rows).unionByName(
        named.filter("label = 0").orderBy(*order).limit(most_rows))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column("text"), BLOCK):
                found = [np.flatnonzero(x).astype(np.int32).tobytes() for x in indicators(data, offsets)]
                rest = batch.slice(first, len(found))
                yield pa.RecordBatch.from_arrays([rest.column("doc_id"), rest.column("label"), pa.array(found, pa.binary())],
                                                 ["doc_id", "label", "places"])

    def fitted(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("places", "ascending")])
        model = fit([np.frombuffer(x, np.int32) for x in table["places"].to_pylist()], table["label"].to_numpy())
        return pa.table({"weight": [model.weight.tobytes()], "square": [model.square.tobytes()], "bias": [model.bias],
                         "slope": [model.slope], "shift": [model.shift]})

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL")
    found = map_batches(texts.join(F.broadcast(chosen), "doc_id"), places, "doc_id long, label int, places binary")
    made = map_groups(found.withColumn("model", F.lit(0)), "model", fitted,
                      "weight binary, square binary, bias double, slope double, shift double").collect()
    if not made:
        return Model(np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0.0, 0.0, 0.0)
    row = made[0]
    return Model(np.frombuffer(row["weight"], np.float32), np.frombuffer(row["square"], np.float32),
                 row["bias"], row["slope"], row["shift"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` (0 to 1) for each row of ``docs``; only the text is looked at.

    A null or empty text has no features and gets the score of the bias alone. A null doc_id is kept, repeated rows give
    equal rows, an empty table gives an empty one. Whole texts are read.
    """
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column("text"), BLOCK):
                for begin in range(0, len(offsets) - 1, 256):
                    part = offsets[begin:begin + 257]
                    s = model.score(indicators(data[part[0]:part[-1]], part - part[0]))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first + begin, len(s)), pa.array(s)],
                                                     ["doc_id", "score"])

    return map_batches(texts_of(docs), scored, "doc_id long, score double")


def fold(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 4."""
    return F.crc32(F.col(doc_id).cast("string")) % 4


HELD_OUT, GOOD = 2, 0.7


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.filter(fold("doc_id") != HELD_OUT), "quality")
    return score(docs, model).select("doc_id", F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                                     (F.col("score") >= GOOD).cast("int").alias("predicted"))
