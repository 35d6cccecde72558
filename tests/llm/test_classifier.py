import numpy as np

from tests.llm.conftest import words
from tidegrid.llm import classifier

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = classifier.op7_quality_classifier(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_odd_rows_and_labels(spark, frame):
    docs = [(i, " ".join(words(i, 40)) if i % 2 else "*** $$$ " * (i + 1)) for i in range(40)]
    odd = [(None, "no id"), (100, None), (101, ""), (7, "twice"), (102, "x" * 300_000)]
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(30)] + [(None, 1, "x"), (31, None, "x"), (999, 1, "x")],
                                   "doc_id BIGINT, quality INT, text STRING")
    df = frame(docs + odd)
    model = classifier.train(df, labels, "quality")
    got = classifier.score(df, model).collect()
    assert len(got) == 45 and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert all((by_id[i] > 0.5) == bool(i % 2) for i in range(30, 40)) and by_id[100] == by_id[101]
    assert classifier.score(frame([]), model).collect() == []
    assert {r["score"] for r in classifier.score(df, classifier.train(df, labels.filter("false"), "quality")).collect()} == {0.5}
    one = classifier.train(df, labels.filter("quality = 1"), "quality")
    assert min(r["score"] for r in classifier.score(df, one).collect()) > 0.9


def test_indicators():
    data = np.frombuffer(b"go go go stop" + b"go stop", np.uint8)
    a, b = classifier.indicators(data, np.array([0, 13, 20]))
    assert a[:4].tolist() == [True, True, False, False] and not b[:4].any()
    alone = classifier.indicators(np.frombuffer(b"go stop", np.uint8), np.array([0, 7]))[0]
    assert (alone == b).all()
    assert not classifier.indicators(np.zeros(0, np.uint8), np.array([0, 0]))[0].any()
