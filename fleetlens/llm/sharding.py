"""Byte-balanced shards by Karmarkar-Karp differencing.

Documents with equal texts form one indivisible group. Groups of at least
1 / (shards * GRAINS) of all bytes are items of their own, so there are at most
shards * GRAINS of them; lighter groups are dealt by hash into as many bundles, and
a bundle is an item. That bounds the items, whatever the number of documents.

Every item starts as a partial partition (its size, 0, 0, ...). The two partial
partitions with the largest spread (largest minus smallest part) are combined
again and again, the largest parts of one with the smallest of the other, until one
is left. The result is sent back to the documents by broadcast of the bounded items.

Slots number the rows of a shard without gaps: rows are counted by shard and by a
hash chunk, a chunk starts where the earlier ones end, and rows are numbered by id
inside their chunk, so no task holds a whole shard.

A null text is empty: no bytes, checksum 0. Sizes have OVERHEAD bytes a document, so
even empty texts count. Repeated rows stay in one shard and get slots of their own;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import two_columns, written

SHARDS = 40
OVERHEAD = 16
#: Items for each shard: more balance better, and cost time on the driver.
GRAINS = 250
#: Rows that one task numbers.
CHUNK_ROWS = 20_000


def differenced(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size, by Karmarkar-Karp differencing."""
    if not sizes:
        return []
    parts, joined, heap = [], [], []
    for i, size in enumerate(sizes):
        first = np.zeros(shards, np.int64)
        first[0] = size
        parts.append(first)
        heap.append((-int(size if shards > 1 else 0), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = parts[a] + parts[b][::-1]
        order = np.argsort(-total, kind="stable")
        joined.append((a, b, order))
        parts[a] = parts[b] = None
        parts.append(total[order])
        heapq.heappush(heap, (-int(parts[-1][0] - parts[-1][-1]), len(parts) - 1))
    label = {len(parts) - 1: np.arange(shards)}
    for node in range(len(parts) - 1, len(sizes) - 1, -1):
        a, b, order = joined[node - len(sizes)]
        own = np.empty(shards, np.int64)
        own[order] = label.pop(node)  # by place before sorting
        label[a], label[b] = own, own[::-1]
    return [int(label[i][0]) for i in range(len(sizes))]


def sharded(docs: DataFrame, shards: int = SHARDS, *, id_col: str = "doc_id", text_col: str = "text",
            grains: int = GRAINS) -> DataFrame:
    """One row per document: its size, checksum, shard and slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = written(two_columns(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("same")), "sizes")
    groups = rows.groupBy("same").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    total, count = groups.agg(F.sum("bytes"), F.sum("rows")).first()
    n = shards * grains
    bundle = F.pmod(F.xxhash64("same"), F.lit(n)).cast("int")
    heavy = F.col("bytes") * n >= F.lit(total or 1)
    items = (groups.withColumn("heavy", heavy)
             .groupBy(F.when(F.col("heavy"), F.col("same")).alias("same"),
                      F.when(~F.col("heavy"), bundle).alias("bundle"))
             .agg(F.sum("bytes").alias("bytes")).collect())
    items.sort(key=lambda r: (-r.bytes, r.bundle if r.bundle is not None else -1, bytes(r.same or b"")))
    placed = differenced([r.bytes for r in items], shards)
    single = spark.createDataFrame([(bytes(r.same), s) for r, s in zip(items, placed, strict=True) if r.same is not None],
                                   "same binary, own int")
    light = spark.createDataFrame([(r.bundle, s) for r, s in zip(items, placed, strict=True) if r.same is None],
                                  "bundle int, common int")
    chunks = max(1, -(-(count or 0) // (shards * CHUNK_ROWS)))
    dealt = (rows.join(F.broadcast(single), "same", "left").withColumn("bundle", bundle)
             .join(F.broadcast(light), "bundle", "left")
             .select("doc_id", "size", "text_crc32", F.coalesce("own", "common").alias("shard"),
                     F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk"), "same"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (dealt.groupBy("shard", "chunk").count()  # shards * chunks rows
              .select("shard", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")))
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "same")
    return (dealt.withColumn("number", F.row_number().over(inside)).join(starts, ["shard", "chunk"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("start") + F.col("number") - 1).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
