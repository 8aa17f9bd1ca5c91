"""Sharding: longest-processing-time scheduling of groups of equal texts.

Rows with equal texts stay together.  A group of more than its share of all
bytes, ``total / (bundles_per_shard * n_shards)``, is an item of its own; fewer
than ``bundles_per_shard * n_shards`` such groups can exist.  All smaller groups
fall into that number of bundles by the hash of their text (a group is never
cut), and each bundle is an item.  Spark sums groups and bundles with map-side
partial sums, so that a text shared by a third of all rows costs one number per
task; the driver sees twice ``bundles_per_shard * n_shards`` numbers at most,
whatever the size of the table.  It takes the items in descending size and gives
each to the least-loaded shard through a heap.

Slots are gapless within a shard.  They come from counts of (shard, section)
pairs, where a section is a hash range of row ids sized to ``section_rows``
rows, so that no task orders a whole shard; the counts stay in the plan.

Null text: no bytes, so size 8 and checksum 0; all null texts are one group.
Null ids are ordered first.  Repeated rows get slots of their own.  An empty
table gives an empty result.  Other columns of the input are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatio.llm.catalog import register
from curatio.llm.common import read

N_SHARDS = 24
OVERHEAD = 8
BUNDLES_PER_SHARD = 2048
SECTION_ROWS = 200_000


def longest_first(sizes: dict[int, int], n_shards: int) -> dict[int, int]:
    """Item -> shard: items in descending size (ties by item), each to the
    shard with the least load (ties by shard)."""
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for item, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        out[item] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return out


def shard_by_size(df: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text",
                  overhead: int = OVERHEAD, bundles_per_shard: int = BUNDLES_PER_SHARD,
                  section_rows: int = SECTION_ROWS) -> DataFrame:
    """(id, size, text_crc32, shard, slot): shards of nearly equal bytes that
    keep equal texts together."""
    spark = df.sparkSession
    text = F.col(text_col)
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("_text_key"),
    ).withColumn("_bundle", F.pmod("_text_key", F.lit(n_shards * bundles_per_shard)).cast("int"))

    totals = rows.groupBy("_bundle").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    n_bundles = n_shards * bundles_per_shard
    total = sum(r["size"] for r in totals)
    large = (rows.groupBy("_text_key").agg(F.sum("size").alias("size"), F.first("_bundle").alias("_bundle"))
             .where(F.col("size") * n_bundles > total).collect())       # fewer than n_bundles groups
    large.sort(key=lambda r: (-r["size"], r["_text_key"]))
    sizes = {r["_bundle"]: r["size"] for r in totals}
    for n, r in enumerate(large):
        sizes[r["_bundle"]] -= r["size"]
        sizes[n_bundles + n] = r["size"]
    shard_of = longest_first(sizes, n_shards)
    assignment = spark.createDataFrame([(b, s) for b, s in shard_of.items() if b < n_bundles], "_bundle int, _bundle_shard int")
    own = spark.createDataFrame([(r["_text_key"], shard_of[n_bundles + n]) for n, r in enumerate(large)], "_text_key long, _own_shard int")
    n_sections = max(1, -(-sum(r["n"] for r in totals) // (n_shards * section_rows)))
    placed = (rows.join(F.broadcast(assignment), "_bundle")       # bounded: n_bundles rows each
              .join(F.broadcast(own), "_text_key", "left")
              .withColumn("shard", F.coalesce("_own_shard", "_bundle_shard"))
              .withColumn("_section", F.pmod(F.xxhash64("doc_id", "_text_key", F.lit(7)), F.lit(8 * n_sections)).cast("int")))

    # one row per section of section_rows / 8 rows, summed up inside the plan
    upto = Window.partitionBy("shard").orderBy("_section").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "_section").agg(F.count(F.lit(1)).alias("_n"))
               .select("shard", "_section", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start")))
    order = Window.partitionBy("shard", "_section").orderBy("doc_id", "_text_key")
    return (placed.withColumn("_rank", F.row_number().over(order))
            .join(offsets, ["shard", "_section"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_rank") - 1).alias("slot")))


@register("op3_sharding")
def op3_sharding(spark, sf_dir):
    return shard_by_size(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
