import random

import pytest

SCHEMA = "doc_id BIGINT, text STRING, row_id STRING, spans INT, bucket STRING, n_tokens STRING, label STRING"


def words(seed, n, vocabulary=400):
    rnd = random.Random(seed)
    return [f"{rnd.choice(['al', 'be', 'Ço', 'du', 'é', 'ñi'])}{rnd.randrange(vocabulary)}" for _ in range(n)]


def varied(seed=0):
    """Documents with shared passages, near copies, exact copies, and everything that may be missing."""
    rnd = random.Random(seed)
    base, passage = words(1, 120), words(2, 30)
    docs = [(i, " ".join(words(100 + i, rnd.randrange(1, 150)))) for i in range(25)]
    for i in range(30, 50):  # near copies of one text
        copy = list(base)
        for at in rnd.sample(range(len(copy)), rnd.randrange(0, 4)):
            copy[at] = f"edit{i}"
        docs.append((i, " ".join(copy)))
    for i in range(50, 66):  # one passage in different surroundings
        docs.append((i, " ".join(words(300 + i, 12) + passage + words(600 + i, 9)) + "\n" + " ".join(passage)))
    docs += [(70, " ".join(base)), (71, " ".join(base).upper()), (72, "a b"), (73, "A  b"), (74, "x " * 300), (75, "x " * 299),
             (76, "short"), (77, ""), (78, None), (79, " \t\r\n\v\f "), (80, "中文字符。" * 60), (81, "中文字符。" * 61),
             (82, " ".join(words(9, 6000, 50)))]
    return docs


@pytest.fixture
def frame(spark):
    """Rows (doc_id, text) with more columns whose names clash with those used on the way."""
    def make(rows):
        return spark.createDataFrame([(d, t, "r", 1, "b", "n", "l") for d, t in rows], SCHEMA).repartition(3)
    return make
