import random

import pytest
from pyspark.errors import PySparkException

from tidegrid.operators import fold as fd
from tidegrid.operators.fold import Fold, fold_scan


def walk(values, fold):
    """A plain loop over one series: group and state of every value."""
    state, group, out = fold.initial, 0, []
    for i, x in enumerate(values):
        state, split = fold.step(state, (x,))
        group += bool(split) and i > 0
        out.append((group, *state))
    return out


def at_most(total):
    """A new group where the group's sum would pass ``total``: the state begins again with each group."""
    def step(state, row):
        x = row[0] or 0
        return ((x,), True) if state[0] + x > total else ((state[0] + x,), False)
    return Fold(["x"], "total BIGINT", (0,), step)


def every(n):
    return Fold(["x"], "seen INT", (0,), lambda s, r: ((1,), True) if s[0] == n else ((s[0] + 1,), False))


#: Never forgets: what it holds depends on all values before.
MIXED = Fold(["x"], "a BIGINT, b STRING", (1, "q"), lambda s, r: (
    ((s[0] * 31 + (r[0] or 7)) % 1009, chr(97 + s[0] % 26)), s[0] % 5 == 0))
#: Few states: on above 30, off below -30.
SWITCH = Fold(["x"], "on BOOLEAN", (False,), lambda s, r: (
    (n := True if (r[0] or 0) > 30 else False if (r[0] or 0) < -30 else s[0],), n != s[0]), [(False,), (True,)])
LATE = Fold(["x"], "last BIGINT", (None,), lambda s, r: ((r[0] if r[0] is not None else s[0],), r[0] is None))


@pytest.mark.parametrize("bits", [4, 40])
@pytest.mark.parametrize("fold", [at_most(60), every(7), MIXED, SWITCH, LATE], ids=["sum", "count", "mixed", "switch", "null"])
def test_a_fold_equals_a_loop(spark, monkeypatch, fold, bits):
    monkeypatch.setattr(fd, "RUN", 3)
    rnd = random.Random(bits)
    series = {s: [(o, rnd.choice([None, rnd.randint(-50, 50)])) for o in sorted(rnd.sample(range(-60, 140), n))]
              for s, n in (("hot", 90), ("b", 12), ("one", 1))}
    data = [(s, o, x, "kept") for s, own in series.items() for o, x in own]
    df = spark.createDataFrame(data, "series STRING, o BIGINT, x BIGINT, other STRING").repartition(3)
    got = fold_scan(df, ["series"], "o", fold, "g", bits)
    assert got.columns == ["series", "o", "x", "other", "g", *fold.schema.names]
    want = [(s, o, x, "kept", *out) for s, own in series.items()
            for (o, x), out in zip(own, walk([x for _, x in own], fold))]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_rounds_follow_what_a_rule_forgets(spark, monkeypatch):
    """A rule that begins again inside every slab settles soon; one that never forgets folds RUN slabs a round in the end."""
    made, write = [], fd.materialize
    monkeypatch.setattr(fd, "materialize", lambda df, name: (made.append(name), write(df, name))[1])
    df = spark.createDataFrame([("s", i, i % 3) for i in range(256)], "series STRING, o BIGINT, x BIGINT")
    since = Fold(["x"], "n INT", (0,), lambda s, r: ((0,), True) if r[0] == 0 else ((s[0] + 1,), False))
    fold_scan(df, ["series"], "o", since, "g", 5).collect()
    assert made.count("fold-again") == 1
    made.clear()
    fold_scan(df, ["series"], "o", MIXED, "g", 4).collect()  # 16 slabs
    assert made.count("fold-again") == fd.EAGER_ROUNDS + 1
    made.clear()
    fold_scan(df, ["series"], "o", SWITCH, "g", 4).collect()
    assert made.count("fold-again") == 0


def test_several_keys_and_columns(spark, rows):
    df = spark.createDataFrame([("a", 1, t, float(t % 4), t % 3 == 0) for t in range(20)] + [("a", 2, 5, 1.0, None)],
                               "s STRING, k INT, t BIGINT, v DOUBLE, flag BOOLEAN")
    rule = Fold(["v", "flag"], "held DOUBLE", (0.0,), lambda s, r: ((r[0] if r[1] else s[0] + r[0],), bool(r[1])))
    got = rows(fold_scan(df, ["s", "k"], "t", rule, bits=2), "k", "t", "group", "held")
    want, held, group = [], 0.0, 0
    for t in range(20):
        held, group = (float(t % 4), group + (t > 0)) if t % 3 == 0 else (held + t % 4, group)
        want.append((1, t, group, held))
    assert got == [*want, (2, 5, 0, 1.0)]


def test_nothing_and_wrong_input(spark):
    df = spark.createDataFrame([], "series STRING, o BIGINT, x BIGINT")
    assert fold_scan(df, ["series"], "o", every(2)).collect() == []
    assert fold_scan(df, ["series"], "o", SWITCH).collect() == []
    with pytest.raises(ValueError, match="there already"):
        fold_scan(df, ["series"], "o", Fold(["x"], "x BIGINT", (0,), lambda s, r: (s, False)))
    with pytest.raises(ValueError, match="not among"):
        fold_scan(df, ["series"], "o", Fold(["x"], "y BIGINT", (0,), lambda s, r: (s, False), [(1,)]))
    bad = spark.createDataFrame([(None, 1, 1)], "series STRING, o BIGINT, x BIGINT")
    with pytest.raises(PySparkException, match="a fold needs keys and order"):
        fold_scan(bad, ["series"], "o", every(2)).collect()
