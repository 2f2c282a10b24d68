"""Sharding by longest-processing-time scheduling.

Documents of equal text form a group that must stay together. Groups go by descending size to the least-loaded shard.
The heap runs over distinct sizes, each with its number of groups: n groups of one size take the n least
(load + i * size) values, as n single pops would. Distinct sizes are few however many groups there are: they sum to the
corpus at most, so there are no more than the square root of twice its bytes.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.text import or_empty
from graphloom.runtime import broadcast_if_few, join_split, stage, with_offsets

SHARDS = 40


def _deal(loads: list[tuple[int, int]], size: int, n: int) -> dict[int, int]:
    """Give ``n`` groups of ``size`` to the heap ``loads`` of (load, shard); how many each shard gets."""
    got: dict[int, int] = {}
    if n <= 4 * len(loads):
        for _ in range(n):
            load, shard = heapq.heappop(loads)
            got[shard] = got.get(shard, 0) + 1
            heapq.heappush(loads, (load + size, shard))
        return got
    low, high = min(loads)[0], max(loads)[0] + size * (n // len(loads) + 2)
    count = lambda top: sum(max(0, (top - x) // size + 1) for x, _ in loads)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if count(mid) >= n else (mid + 1, high)
    spare = count(low) - n
    for load, shard in sorted(loads, key=lambda x: -x[1]):
        k = max(0, (low - load) // size + 1)
        if spare and k and (low - load) % size == 0:
            k, spare = k - 1, spare - 1
        got[shard] = k
    loads[:] = [(x + size * got[s], s) for x, s in loads]
    heapq.heapify(loads)
    return got


def lpt_plan(sizes: list[tuple[int, int]], shards: int = SHARDS) -> list[tuple[int, list[int], list[int]]]:
    """For each (size, groups), sizes descending: the shards that get some of its groups, and how many groups they and those before them get."""
    loads = [(0, s) for s in range(shards)]
    heapq.heapify(loads)
    plan = []
    for size, n in sorted(sizes, reverse=True):
        got = [(s, k) for s, k in sorted(_deal(loads, size, n).items()) if k]
        plan.append((size, [s for s, _ in got], list(accumulate(k for _, k in got))))
    return plan


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per input row: ``key``, size, text_crc32, shard, slot, and ``_hash`` of the text.

    Size is the UTF-8 length of the text (null and empty: 0) plus 16. Equal texts, null counting as empty, share a
    shard. Slots number a shard's rows from 0 without gaps; ties go by the input order of rows, and repeated rows get
    slots of their own. An empty table gives no rows. Other columns of ``docs`` are not read.

    Sizes are true ones at every scale. Only their histogram reaches the driver; a text of any length is hashed in its row.
    """
    spark = docs.sparkSession
    raw = F.encode(or_empty(text), "utf-8")
    slim = docs.select(
        F.col(key).alias("id"),
        (F.octet_length(or_empty(text)) + F.lit(16)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.unhex(F.sha2(or_empty(text), 256)).alias("digest"),
        F.xxhash64(or_empty(text)).alias("_hash"),
        F.monotonically_increasing_id().alias("_row"),
    )
    slim = stage(slim, "sizes")
    rows = slim.count()
    groups = slim.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    groups = stage(groups.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(64)).cast("int")), "groups")
    sizes = groups.groupBy("bytes").count().toPandas()
    plan = lpt_plan(list(zip(sizes["bytes"].tolist(), sizes["count"].tolist())), shards)
    plan = spark.createDataFrame(pd.DataFrame(plan, columns=["bytes", "shards", "upto"]), "bytes long, shards array<int>, upto array<long>")
    ranked = with_offsets(groups, ["bytes"], "part", F.lit(1), "before")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("bytes", "part").orderBy("digest")) - 1
    ranked = ranked.withColumn("rank", rank).join(broadcast_if_few(plan), "bytes")
    shard = F.get("shards", F.size(F.filter("upto", lambda e: e <= F.col("rank"))))
    placed = stage(ranked.select("digest", "n", shard.cast("int").alias("shard")), "placed")
    out = join_split(slim, placed, "digest", "n", rows).withColumn("part", F.pmod(F.xxhash64("_row"), F.lit(1024)).cast("int"))
    out = with_offsets(out.select("id", "size", "text_crc32", "_hash", "_row", "shard", "part"), ["shard"], "part", F.lit(1), "before")
    slot = F.col("before") + F.row_number().over(Window.partitionBy("shard", "part").orderBy("_row")) - 1
    return out.select(F.col("id").alias(key), "size", "text_crc32", "_hash", "shard", slot.cast("long").alias("slot"))
