"""Labels spread out on axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.spread import spread_positions
from tidegrid.registry import query, rounded, table

WIDTH, LEAST, MOST = 60.0, -1000.0, 11000.0
#: Slabs of the order below, a sum of cents and a key.
BITS = 43


def _begin(x: str) -> str:
    size = f"{x}.n * {WIDTH}"
    return (f"(CASE WHEN {x}.n = 1 THEN {x}.lo - {WIDTH / 2} WHEN {size} > {MOST - LEAST} THEN {(LEAST + MOST) / 2} - {size} / 2 "
            f"ELSE least(greatest(({x}.lo + {x}.hi) / 2 - {size} / 2, {LEAST}), {MOST} - {size}) END)::DOUBLE")


_OVERLAP = (f"{_begin('a[-1]')} < {_begin('b[1]')} + b[1].n * {WIDTH} AND {_begin('b[1]')} < {_begin('a[-1]')} + a[-1].n * {WIDTH}")


@query(f"""WITH RECURSIVE c AS (SELECT c_nationkey AS axis, CAST(c_acctbal AS DOUBLE) AS p, c_custkey AS id FROM customer),
up AS (SELECT axis, list(struct_pack(lo := p, hi := p, n := CAST(1 AS BIGINT)) ORDER BY p, id) AS g, CAST(NULL AS BIGINT) AS before
  FROM c GROUP BY axis
  UNION ALL SELECT axis, list_reduce(list_transform(g, lambda x: [x]), lambda a, b: CASE WHEN {_OVERLAP}
    THEN list_append(a[:-2], struct_pack(lo := least(a[-1].lo, b[1].lo), hi := greatest(a[-1].hi, b[1].hi), n := a[-1].n + b[1].n))
    ELSE list_concat(a, b) END), len(g) FROM up WHERE before IS NULL OR len(g) < before),
done AS (SELECT axis, arg_min(g, len(g)) AS g FROM up GROUP BY axis),
placed AS (SELECT axis, flatten(list_transform(g, lambda x: list_transform(range(x.n), lambda i: {_begin('x')} + {WIDTH / 2} + i * {WIDTH})))
  AS s FROM done),
nth AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY p, id) AS r FROM c)
SELECT axis, id, round(p, 2) AS p, round(s[r], 6) AS spread FROM nth JOIN placed USING (axis)""")
def spread_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for every customer on an axis of balances for each nation, spread until none covers another."""
    customers = table(spark, sf_dir, "customer")
    cents = F.round((F.col("c_acctbal") + 100_000) * 100).cast("long")
    labels = customers.select(F.col("c_nationkey").alias("axis"), F.col("c_custkey").cast("long").alias("id"),
                              F.col("c_acctbal").cast("double").alias("p"), (cents * 10_000_000 + F.col("c_custkey")).alias("_at"))
    out = spread_positions(labels, ["axis"], "_at", "p", WIDTH, LEAST, MOST, BITS).drop("_at")
    return rounded(rounded(out, "p", places=2), "spread", places=6)
