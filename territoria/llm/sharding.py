"""Sharding by longest processing time: groups that must stay together, the largest first, to the least loaded shard.

The schedule itself runs over a number of items that does not depend on the table: every group of more than
1 / (shards * FINE) of all bytes is an item of its own (there can't be more than shards * FINE of those), and the
smaller groups are dealt by hash into bundles of about that size. A heap then takes the items by size.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territoria.llm.common import documents, stored

SHARDS = 40
#: Items for each shard, at most about twice this. Loads differ by about one bundle: 1 / FINE of a shard.
FINE = 512
#: Rows that one task numbers.
RUN = 100_000


def schedule(sizes: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Longest processing time: (size, item) pairs to shards."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, item in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def shard(docs: DataFrame, shards: int = SHARDS, fine: int = FINE, run: int = RUN) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Law: ``bytes``. A group is all rows of one text; null counts as empty and lies with the empty texts. Size is the
    UTF-8 bytes and 16 more a row. Slots are gapless from 0 in each shard. Repeated rows get a slot each. An empty
    table gives no rows. A group larger than a shard's fair share has a shard (nearly) to itself.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"),
    ), "sizes")
    groups = stored(slim.groupBy("digest").agg(F.sum("size").alias("size")), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    least = max(1, total // (shards * fine))
    bundle = F.pmod(F.xxhash64("digest"), F.lit(max(1, shards * fine)))
    large = groups.where(F.col("size") > least).collect()  # fewer than shards * fine rows, as each holds over 1 / (shards * fine)
    small = groups.where(F.col("size") <= least).groupBy(bundle.cast("long").alias("item")).agg(F.sum("size").alias("size")).collect()
    plan = schedule([(r["size"], (0, bytes(r["digest"]))) for r in large] + [(r["size"], (1, r["item"].to_bytes(8, "little"))) for r in small], shards)
    spark = docs.sparkSession
    of_group = spark.createDataFrame([(bytearray(k[1]), s) for k, s in plan.items() if k[0] == 0], "digest binary, own int")
    of_bundle = spark.createDataFrame([(int.from_bytes(k[1], "little"), s) for k, s in plan.items() if k[0] == 1], "item long, dealt int")
    placed = (
        slim.withColumn("item", bundle.cast("long"))
        .join(F.broadcast(of_group), "digest", "left")  # both tables have at most shards * fine rows
        .join(F.broadcast(of_bundle), "item", "left")
        .withColumn("shard", F.coalesce("own", "dealt"))
    )
    return numbered(placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard"), shards, run).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def numbered(placed: DataFrame, shards: int, run: int) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard: rows are numbered in runs of bounded size, and each run starts after
    those before it."""
    from pyspark.sql import Window

    placed = stored(placed, "placed")
    runs = max(1, math.ceil(placed.count() / (shards * run)))
    dealt = placed.withColumn("run", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(runs)).cast("long"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    in_run = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    return dealt.withColumn("at", F.row_number().over(in_run) - 1).join(starts, ["shard", "run"]).withColumn("slot", (F.col("start") + F.col("at")).cast("long"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
