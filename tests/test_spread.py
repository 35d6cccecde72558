import random

import pytest
from pyspark.errors import PySparkException

from tidegrid.operators.spread import begins_at, spread_positions


def plain(positions, width, least, most):
    """Pools in passes from left to right, until a pass changes nothing."""
    pools = [(p, p, 1) for p in positions]
    while True:
        out = []
        for low, high, n in pools:
            if out:
                a, b = begins_at(*out[-1], width, least, most), begins_at(low, high, n, width, least, most)
                if a < b + n * width and b < a + out[-1][2] * width:
                    out[-1] = (min(out[-1][0], low), max(out[-1][1], high), out[-1][2] + n)
                    continue
            out.append((low, high, n))
        if out == pools:
            return [begins_at(*p, width, least, most) + width / 2 + i * width for p in pools for i in range(p[2])]
        pools = out


CASES = {"apart": ([0.0, 20.0, 40.5], [0.0, 20.0, 40.5]), "one": ([7.0], [7.0]), "pair": ([30.0, 30.0], [20.0, 40.0]),
         "grows": ([28.0, 30.0, 32.0], [10.0, 30.0, 50.0]), "chain": ([40.0, 60.0, 80.0, 80.0], [30.0, 50.0, 70.0, 90.0]),
         "low": ([1.0, 2.0], [10.0, 30.0]), "high": ([199.0, 199.5], [170.0, 190.0]),
         "full": ([100.0] * 11, [i * 20.0 for i in range(11)])}


def test_examples_and_random_positions(spark):
    rnd = random.Random(6)
    asked = {k: p for k, (p, _) in CASES.items()}
    asked |= {f"r{i}": sorted(rnd.choice([rnd.uniform(-5, 205), float(rnd.randrange(0, 200, 10))]) for _ in range(n))
              for i, n in enumerate((2, 5, 9, 9, 14))}
    df = spark.createDataFrame([(k, i, p, "kept") for k, own in asked.items() for i, p in enumerate(own)],
                               "axis STRING, i BIGINT, p DOUBLE, count STRING").repartition(3)
    got = {}
    for r in spread_positions(df, ["axis"], "i", "p", 20.0, 0.0, 200.0, bits=2).orderBy("axis", "i").collect():
        got.setdefault(r["axis"], []).append(r["spread"])
        assert r["count"] == "kept" and r["p"] == asked[r["axis"]][r["i"]]
    for k, (_, want) in CASES.items():
        assert got[k] == want, k
    assert got == {k: pytest.approx(plain(p, 20.0, 0.0, 200.0)) for k, p in asked.items()}
    for own in got.values():
        assert all(b - a >= 20.0 - 1e-9 for a, b in zip(own, own[1:]))


def test_none_and_unsorted(spark):
    schema = "axis STRING, i BIGINT, p DOUBLE"
    assert spread_positions(spark.createDataFrame([], schema), ["axis"], "i", "p", 1.0, 0.0, 9.0).collect() == []
    with pytest.raises(PySparkException, match="positions go back"):
        spread_positions(spark.createDataFrame([("a", 0, 2.0), ("a", 1, 1.0)], schema), ["axis"], "i", "p", 1.0, 0.0, 9.0)
