"""Connected components of a graph given by its edges, by Spark jobs alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``row_id, component`` for each node that has an edge (a, b): the smallest node that can be reached.

    Each round hangs all neighbours of a node, itself included, under the smallest of them: first those larger than the node,
    then those smaller. Trees become stars in about log(longest path) rounds; a node's neighbours are never gathered.
    """
    both = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, before = materialize(both, "links"), None
    while True:
        # large star: of each node, all larger neighbours go under the smallest neighbour
        around = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: all smaller neighbours go under the smallest of them, as the node does
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialize(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = links.select(F.col("u").alias("row_id"), F.col("v").alias("component"))
    return stars.unionAll(links.select(F.col("v").alias("row_id"), F.col("v").alias("component")).distinct())
