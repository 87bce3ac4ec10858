"""Sharding by Karmarkar-Karp differencing.

Equal texts are one indivisible group. Groups above 1/CHUNKS of all bytes are items of their own, so there are
at most CHUNKS of them; the rest fall by hash into CHUNKS chunks, each one item. Whatever the input, the driver
differences at most 2 * CHUNKS items: the two partial partitions with the largest spread are combined again and
again, the largest part of one with the smallest of the other. Rows learn their shard from two small maps of at
most CHUNKS entries each; texts are never shuffled.

Defined cases: null text has size 1 and is a group of its own; repeated rows are all placed; an empty table
gives no rows; with fewer groups than shards some shards stay empty. A group larger than the ideal shard makes
its shard larger than that, as it can't be divided.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

SHARDS = 16
#: Most chunks and most large groups that the driver differences.
CHUNKS = 4096
#: Parts of a shard that are numbered apart, so that no task numbers a whole shard.
BUCKETS = 1024


def difference(sizes: list[int], parts: int) -> list[int]:
    """The part of each item, by differencing. Ties go by the item's place, so the result is fixed."""
    if not sizes:
        return []
    # a slot is a tree of items: a leaf is an item's number, an inner node joins two slots, None is empty
    heap = [(-s, i, [s] + [0] * (parts - 1), [i] + [None] * (parts - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    joins: list[tuple] = []
    ticket = len(sizes)
    while len(heap) > 1:
        _, _, sums, slots = heapq.heappop(heap)
        _, _, other, others = heapq.heappop(heap)
        both = []
        for s, a, t, b in zip(sums, slots, reversed(other), reversed(others)):
            if a is not None and b is not None:
                joins.append((a, b))
                both.append((s + t, -len(joins)))
            else:
                both.append((s + t, b if a is None else a))
        both.sort(key=lambda x: -x[0])
        least = both[-1][0]
        heapq.heappush(heap, (-(both[0][0] - least), ticket, [s - least for s, _ in both], [x for _, x in both]))
        ticket += 1
    out = [0] * len(sizes)
    for part, slot in enumerate(heap[0][3]):
        todo = [slot] if slot is not None else []
        while todo:
            x = todo.pop()
            if x >= 0:
                out[x] = part
            else:
                todo += joins[-x - 1]
    return out


def assign(docs: DataFrame, shards: int = SHARDS, chunks: int = CHUNKS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    rows = common.stored(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
            common.text_key(F.col("text")).alias("key"),
        ),
        "shard-rows",
    ).withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int"))
    groups = rows.groupBy("key", "chunk").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = F.col("bytes") * chunks > total
    items = groups.groupBy(F.when(large, F.col("key")).alias("key"), F.when(~large, F.col("chunk")).alias("chunk")).agg(F.sum("bytes").alias("bytes"))
    # at most 2 * chunks rows, by the definition of large
    found = sorted(items.collect(), key=lambda r: (-r.bytes, r.key or "", -1 if r.chunk is None else r.chunk))
    placed = list(zip(found, difference([r.bytes for r in found], shards)))
    of_large = spark.createDataFrame([(r.key, s) for r, s in placed if r.key is not None], "key string, large_shard int")
    of_chunk = spark.createDataFrame([(r.chunk, s) for r, s in placed if r.key is None], "chunk int, chunk_shard int")
    rows = rows.join(F.broadcast(of_large), "key", "left").join(F.broadcast(of_chunk), "chunk", "left")
    return numbered(rows.withColumn("shard", F.coalesce("large_shard", "chunk_shard")))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds slot, a gapless number from 0 in each shard. Buckets of a shard are numbered apart and then offset."""
    rows = rows.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    counts = rows.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("nth", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot"))
    )


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 of near equal bytes."""
    rows = assign(common.read(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
