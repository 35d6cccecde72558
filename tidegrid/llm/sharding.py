"""Shards by fixed virtual slots.

Records are hashed into thousands of slots; only the table of slots (rows and bytes of each, bounded by their number) reaches
the driver, which deals slots to shards by their bytes. The map is stored in versions: rebalancing reads the last version,
moves as few slots as it needs to, and writes the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegrid.session import new_folder

SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, rows long, bytes long, shard int"


def with_slot(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot``: the slot is a hash of doc_id, or of the text where that is null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.col("doc_id").cast("long")))
    return docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
                       F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_table(sized: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, rows, bytes) of every slot that has rows: at most as many as there are slots."""
    found = sized.groupBy("virtual_slot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()
    return sorted((r["virtual_slot"], r["rows"], r["bytes"]) for r in found)


def deal(slots: Sequence[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """Slot to shard: the largest slot first, each to the shard with the fewest bytes so far."""
    load = [0] * shards
    owner = {}
    for slot, _, size in sorted(slots, key=lambda s: (-s[2], s[0])):
        shard = min(range(shards), key=lambda k: (load[k], k))
        owner[slot] = shard
        load[shard] += size
    return owner


def rebalance(slots: Sequence[tuple[int, int, int]], owner: dict[int, int], shards: int,
              tolerance: float = 0.01) -> dict[int, int]:
    """``owner`` for ``shards`` shards, at least as many as before, moving few slots.

    New shards, if there are any, take slots from the fullest shards until they hold the mean but for ``tolerance`` of it,
    and nothing else moves. Else the emptiest shard takes them, while some shard is further from the mean than that. No move
    makes its target as large as its source was.
    """
    fresh = sorted(set(range(shards)) - set(owner.values()))
    size = {s: b for s, _, b in slots}
    owner = {s: owner.get(s, -1) for s in size}
    load, held = [0] * shards, [[] for _ in range(shards)]
    for s, k in sorted(owner.items(), key=lambda x: (-size[x[0]], x[0])):
        if k < 0:  # a slot that had no rows before
            k = owner[s] = min(range(shards), key=lambda j: (load[j], j))
        load[k] += size[s]
        held[k].append(s)
    mean = sum(load) / shards
    while (any(load[k] < (1 - tolerance) * mean for k in fresh) if fresh else
           any(abs(n - mean) > tolerance * mean for n in load)):
        low = min(fresh or range(shards), key=lambda k: (load[k], k))
        high = max(range(shards), key=lambda k: (load[k], -k))
        fitting = [s for s in held[high] if load[low] + size[s] < load[high]]
        if not fitting:
            break
        s = max(fitting, key=lambda x: (min(size[x], (load[high] - load[low]) / 2), -size[x], -x))
        held[high].remove(s)
        held[low].append(s)
        load[high] -= size[s]
        load[low] += size[s]
        owner[s] = low
    return owner


def store_map(spark: SparkSession, path: str, version: int, slots: Sequence[tuple[int, int, int]],
              owner: dict[int, int]) -> None:
    """Write one version of the map; a version that is there already is an error."""
    rows = [(version, s, n, b, owner[s]) for s, n, b in slots]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{path}/map-{version:06d}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/map-{version:06d}")


def assign(sized: DataFrame, slot_map: DataFrame) -> DataFrame:
    """The shard of each row and its place in the shard, gapless from 0 in the order of (virtual slot, doc_id, ...).

    A slot's places begin after the rows of its shard's earlier slots, so rows are numbered inside their slot only.
    """
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    begins = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return (sized.withColumn("nth", F.row_number().over(inside) - 1)
            .join(F.broadcast(begins), "virtual_slot")  # a row for each slot at most
            .withColumn("slot", (F.col("begin") + F.col("nth")).cast("long")).drop("begin", "nth"))


def shard(docs: DataFrame, shards: int, path: str, slots: int = SLOTS) -> DataFrame:
    """Deal ``docs`` (doc_id, text; other columns are not read) to shards of near equal bytes; version 1 of the map goes to ``path``.

    Returns ``doc_id, size, text_crc32, virtual_slot, shard, slot``; ``size`` is the text's UTF-8 bytes plus 1, a null text
    counts as empty. Rows with null doc_id are dealt by their text; repeated rows are all kept, in places next to each
    other; an empty table gives an empty one and an empty map.
    """
    sized = with_slot(docs, slots)
    table = slot_table(sized)
    store_map(docs.sparkSession, path, 1, table, deal(table, shards))
    return assign(sized, read_map(docs.sparkSession, path, 1))


def grow(docs: DataFrame, shards: int, path: str, version: int, slots: int = SLOTS) -> DataFrame:
    """``shard`` by the version after ``version``, edited for ``shards`` shards and for what ``docs`` holds now.

    Null, empty, repeated and missing rows are dealt as ``shard`` does; a slot that had no rows before goes to the shard with the
    fewest bytes. Fewer shards than the version has, or a version that is there already, are errors.
    """
    spark = docs.sparkSession
    sized = with_slot(docs, slots)
    table = slot_table(sized)
    before = {r["virtual_slot"]: r["shard"] for r in read_map(spark, path, version).collect()}
    store_map(spark, path, version + 1, table, rebalance(table, before, shards))
    return assign(sized, read_map(spark, path, version + 1))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``; ``slot`` is the place in the shard, ``virtual_slot`` the hashed slot."""
    dealt = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16, new_folder(spark, "slot-map"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
