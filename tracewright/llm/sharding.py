"""Sharding by longest-processing-time scheduling.

Groups of equal texts, largest first, go to the least-loaded shard through a heap. Groups of one size are
interchangeable, so the schedule needs only how many groups there are of each size: the driver gets that histogram,
says how many groups of a size each shard takes, and groups find their place by their number within their size. All
loads are those of the plain heap over all groups.

Defined results: null text counts as empty, and so belongs to the group of empty texts; repeated rows are rows of one
group; a null id is kept; equal sizes are told apart by the digest of the text and equal loads by the shard's number,
so a rerun gives the same; columns other than the id and the text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import materialize

#: Rows, or groups of one size, that are numbered in one task, about.
SLOTS_PER_TASK = 50_000
#: Groups with more than one in so many rows are sent to every executor, at most so many; the others meet in a shuffle.
HOT = 1_000
#: Sizes that are sent to every executor at most; more go by a shuffle.
BROADCAST_SIZES = 200_000


def longest_first(sizes: Iterable[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """For (size, how many groups): (size, how many of them go to each shard), the largest size first, each group to
    the shard with the least so far, of these the first."""
    load = [0] * shards
    out = []
    for size, groups in sorted(sizes, reverse=True):
        given = [0] * shards
        left = groups
        if groups > 4 * shards:
            # The picks are the least of load + k * size over all shards and k: all those below a level come first.
            low, high = min(load), max(load) + size * (groups + 1)
            below = lambda level: [max(0, -(-(level - x) // size)) for x in load]
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if sum(below(mid)) <= groups else (low, mid)
            given = below(low)
            left = groups - sum(given)
        heap = [(x + size * k, s) for s, (x, k) in enumerate(zip(load, given, strict=True))]
        heapq.heapify(heap)
        for _ in range(left):
            x, s = heap[0]
            given[s] += 1
            heapq.heapreplace(heap, (x + size, s))
        load = [x + size * k for x, k in zip(load, given, strict=True)]
        out.append((size, given))
    return out


def placements(histogram: pd.DataFrame, shards: int) -> pd.DataFrame:
    """``group_size, buckets, to``: into how many parts the groups of a size are numbered, and for each shard that
    takes some the number that its groups end before."""
    rows = []
    for size, given in longest_first(zip(histogram["group_size"].tolist(), histogram["groups"].tolist(), strict=True), shards):
        end, to = 0, []
        for s, k in enumerate(given):
            if k:
                end += k
                to.append((end, s))
        rows.append((size, max(1, -(-end // SLOTS_PER_TASK)), to))
    return pd.DataFrame(rows, columns=["group_size", "buckets", "to"])


def numbered(rows: DataFrame, by: str, buckets, order: list, weight: str | None = None) -> DataFrame:
    """``rows`` with ``at``: a running number (or sum of ``weight``) from 0 within ``by``. Rows are dealt to ``buckets``
    parts by a hash; no task sees more than a part, and a count for each part."""
    n = F.sum(weight) if weight else F.count("*")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("digest", *([weight] if weight else [])), buckets.cast("long")))
    counts = rows.groupBy(by, "bucket").agg(n.alias("part"))
    before = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(by, "bucket", F.coalesce(F.sum("part").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(by, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce((F.sum(weight) if weight else F.count("*")).over(inside), F.lit(0)))
    return rows.join(counts, [by, "bucket"]).withColumn("at", F.col("start") + F.col("inside")).drop("bucket", "start", "inside")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """``id_col, size, text_crc32, shard, slot``; slots count from 0 in each shard without gaps.

    Texts are read once and reduced to a digest and a size, which the shared folder keeps. Group sizes are sums with
    partial aggregation, so a hot group costs one row per task. The driver gets a row for each different group size:
    there are fewer than the root of twice all bytes, some hundred thousands in practice. Groups of a size and rows of a
    shard are numbered in parts; no task sees a whole shard.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("digest"),
    )
    base = materialize(base, "sizes")
    groups = materialize(base.groupBy("digest").agg(F.sum("size").alias("group_size"), F.count("*").alias("rows")), "groups")
    histogram = groups.groupBy("group_size").agg(F.count("*").alias("groups")).toArrow().to_pandas()
    rows = base.count()
    plan = spark.createDataFrame(placements(histogram, shards), "group_size long, buckets int, to array<struct<before:long, shard:int>>")
    plan = F.broadcast(plan) if len(histogram) <= BROADCAST_SIZES else materialize(plan, "plan")
    placed = numbered(groups.join(plan, "group_size"), "group_size", F.col("buckets"), [F.col("digest")])
    placed = placed.select("digest", "rows", F.filter("to", lambda x: F.col("at") < x.before)[0].shard.alias("shard"))
    placed = materialize(placed, "placed")
    # At most ``HOT`` groups.
    hot = F.broadcast(placed.where(F.col("rows") * HOT > rows).select("digest", F.col("shard").alias("own")))
    parted = base.join(hot, "digest", "left")
    often = parted.where("own is not null").withColumnRenamed("own", "shard")
    seldom = parted.where("own is null").drop("own").join(placed.where(F.col("rows") * HOT <= rows).select("digest", "shard"), "digest")

    same = often.select("shard", "id", "digest", "size", "text_crc32").unionByName(seldom.select("shard", "id", "digest", "size", "text_crc32"))
    same = same.groupBy("shard", "id", "digest", "size", "text_crc32").agg(F.count("*").alias("n"))
    same = same.withColumn("digest", F.struct("id", "digest"))
    out = numbered(same, "shard", F.lit(max(1, -(-rows // (shards * SLOTS_PER_TASK)))), [F.col("id").asc_nulls_last(), F.col("digest")], "n")
    slot = F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", slot.alias("slot"))
