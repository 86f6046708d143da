"""Byte-balanced sharding by Karmarkar-Karp differencing.

Equal texts are one indivisible group. Group sizes are a partial aggregate; groups of at least
1 / (shards * HEAVY) of all bytes are items by themselves (at most shards * HEAVY of them), all others are
dealt by hash into BINS items, so what the driver differences is bounded whatever the input. The two
partial partitions with the largest spread are joined over and over, the heaviest part of one with the
lightest of the other. Slots are numbered from 0 without gaps in each shard, by counts of hash ranges, so
no shard's rows meet in one task.

A null text counts as empty: size 1, checksum 0. Repeated rows, ties and null ids get slots of their own.
Long texts weigh their bytes. An empty table gives an empty result. Other columns are not touched.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.columns import text_or_empty
from tallyfold.plans.storage import write_table

SHARDS, HEAVY, BINS, ROWS_A_RANGE = 16, 1024, 4096, 50_000


def difference(sizes: list[int], shards: int) -> list[int]:
    """The part of each item; ties go by the items' order."""
    heap: list = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [(0, None)] * (shards - 1) + [(size, i)]))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # a ascends, b descends: heavy parts meet light ones.
        both = sorted(((x + y, (m, n) if m is not None and n is not None else m if n is None else n) for (x, m), (y, n) in zip(a, reversed(b))), key=lambda p: p[0])
        least = both[0][0]
        both = [(x - least, m) for x, m in both]
        heapq.heappush(heap, (-both[-1][0], serial, both))
        serial += 1
    part = [0] * len(sizes)
    for shard, (_, tree) in enumerate(heap[0][2] if heap else []):
        left = [] if tree is None else [tree]
        while left:
            node = left.pop()
            if isinstance(node, tuple):
                left.extend(node)
            else:
                part[node] = shard
    return part


def shard_by_bytes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row."""
    spark = documents.sparkSession
    raw = text_or_empty(F.col(text))
    base = write_table(
        documents.select(
            F.col(doc_id).alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("crc"),
            F.sha2(raw.cast("binary"), 256).alias("name"),
        ),
        "sizes",
    )
    groups = base.groupBy("name").agg(F.sum("size").alias("bytes"))
    groups = write_table(groups, "groups")
    total, rows = groups.agg(F.sum("bytes")).first()[0] or 0, base.count()
    heavy = F.col("bytes") * (shards * HEAVY) >= total
    bin_ = F.concat(F.lit("bin-"), F.pmod(F.xxhash64("name"), F.lit(BINS)))
    items = groups.select(F.when(heavy, F.col("name")).otherwise(bin_).alias("item"), "bytes").groupBy("item").agg(F.sum("bytes").alias("bytes"))
    listed = sorted(items.collect())  # at most shards * HEAVY + BINS rows
    placed = list(zip((r["item"] for r in listed), difference([r["bytes"] for r in listed], shards)))
    place = spark.createDataFrame(placed, "item string, shard int")
    alone, dealt = place.where("item NOT LIKE 'bin-%'"), place.where("item LIKE 'bin-%'")
    put = base.join(F.broadcast(alone.withColumnRenamed("item", "name").withColumnRenamed("shard", "own")), "name", "left")
    put = put.withColumn("item", bin_).join(F.broadcast(dealt), "item", "left")
    ranges = max(1, math.ceil(rows / (shards * ROWS_A_RANGE)))
    put = put.select("id", "size", "crc", F.coalesce("own", "shard").alias("shard"), F.pmod(F.xxhash64("id", "crc"), F.lit(ranges)).alias("range"))
    counts = put.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "range").orderBy("id", "crc")
    out = put.withColumn("at", F.row_number().over(order) - 1).join(starts, ["shard", "range"])
    return out.select(
        F.col("id").alias(doc_id), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
