"""Shards of near-equal size by longest-processing-time scheduling.

Groups of equal texts stay together. A group whose bytes exceed a fixed share of the corpus is an item of its own; there are at most `shards * FINE`
of those whatever the corpus holds, since their sizes add up to no more than the whole. All other groups are dealt by the hash of their text to
`shards * FINE` bundles. Both kinds, sorted by size, go one by one to the least-loaded shard through a heap on the driver, so its state is bounded by
the two constants and not by the number of groups, and a shard is off the mean by no more than one item's size.

Defined cases: a null text counts as empty (size 1, crc 0, one group with the empty texts). Repeated rows are rows of their own.
Ties in size go by kind and key, in load by shard number. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

SHARDS, FINE, SLICES = 16, 256, 256


def lpt(items: list[tuple[int, object]], shards: int) -> list[int]:
    """Shard of each (size, key): by descending size, each to the least-loaded shard so far."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], str(items[i][1]))):
        load, s = heapq.heappop(heap)
        out[i] = s
        heapq.heappush(heap, (load + items[i][0], s))
    return out


def shard(docs: DataFrame, shards: int = SHARDS, fine: int = FINE) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    rows = durable(rows.withColumn("bundle", F.pmod(F.xxhash64("key"), F.lit(shards * fine)).cast("int")))
    groups = durable(rows.groupBy("key", "bundle").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    limit = total // (shards * fine)
    large = groups.where(F.col("bytes") > limit).collect()  # fewer than shards * fine, as their bytes add up to the total at most
    small = groups.where(F.col("bytes") <= limit).groupBy("bundle").agg(F.sum("bytes").alias("bytes")).collect()
    items = [(r["bytes"], bytes(r["key"])) for r in large] + [(r["bytes"], r["bundle"]) for r in small]
    placed = lpt(items, shards)
    own = spark.createDataFrame([(k, s) for (_, k), s in zip(items, placed, strict=True) if isinstance(k, bytes)], "key binary, own int")
    rest = spark.createDataFrame([(k, s) for (_, k), s in zip(items, placed, strict=True) if isinstance(k, int)], "bundle int, rest int")
    put = rows.join(F.broadcast(own), "key", "left").join(F.broadcast(rest), "bundle", "left").withColumn("shard", F.coalesce("own", "rest"))
    # slots: places within a slice of a shard, after the rows of the slices before it
    put = put.withColumn("slice", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SLICES)).cast("int")).select("doc_id", "size", "text_crc32", "shard", "slice")
    counts = put.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = counts.select("shard", "slice", (F.sum("n").over(Window.partitionBy("shard").orderBy("slice")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size"))
    numbered = put.withColumn("place", place).join(F.broadcast(before), ["shard", "slice"])  # at most shards * SLICES rows
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
