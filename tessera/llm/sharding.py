"""Sharding by longest processing time first, groups kept whole.

Documents of equal text form a group. Groups go, largest first and those of
equal size by a digest of their text, to the least-loaded shard through a heap.
The heap sees each distinct size with the number of its groups: groups of one
size go around the shards that are level with each other, so a run of them is
one step however long, and the result is that of a heap that takes every group
by itself. A group finds its run by its size and its rank among those of its
size. The driver holds one row a distinct size; these add up to at most all
bytes, so there are fewer than sqrt(2 * bytes), and no more than the largest group has bytes.

Law: ``bytes`` (sizes near equal). Slots number a shard's rows without gaps;
they are ranked in many slices of the shard.

Defined cases: null text counts as empty text; null and repeated doc_ids are
rows like others; rows of equal text share a shard; an empty table gives no
rows. Other columns are neither read nor changed.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import ranked, stored

#: most distinct sizes whose runs go to every task; more are joined by size
BROADCAST_SIZES = 100_000


def longest_first(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """(size, runs) for (size, jobs of that size); in a run (first, order), jobs from number ``first`` on go to the
    shards of ``order``, around and around."""
    loads = [0] * shards
    out = []
    for size, jobs in sorted(sizes, reverse=True):
        # a job raises its shard by one level of ``size``: the least load is the least level, then remainder, then shard
        heap = [(load // size, load % size, s) for s, load in enumerate(loads)]
        heapq.heapify(heap)
        level: list[tuple[int, int]] = []  # shards on the level, by remainder
        runs, first = [], 0
        while first < jobs:
            at = heap[0][0] if heap else None
            while heap and heap[0][0] == at:
                level.append(heapq.heappop(heap)[1:])
            level.sort()
            room = (heap[0][0] - at) * len(level) if heap else jobs
            take = min(jobs - first, room)
            runs.append((first, [s for _, s in level]))
            for i, (_, s) in enumerate(level):
                loads[s] += size * (take // len(level) + (i < take % len(level)))
            first += take
        out.append((size, runs))
    return out


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("_text")), "shard-rows")
    groups = stored(rows.groupBy("_text").agg(F.sum("size").alias("bytes")), "shard-groups")
    sizes = [(int(r["bytes"]), int(r["jobs"])) for r in groups.groupBy("bytes").agg(F.count("*").alias("jobs")).collect()]  # bounded as above
    plan = spark.createDataFrame(longest_first(sizes, shards), "_bytes long, runs array<struct<first: long, order: array<int>>>")
    numbered = ranked(groups, ["bytes"], [F.col("_text")], "rank")
    placed_by = numbered.join(F.broadcast(plan) if len(sizes) <= BROADCAST_SIZES else plan, F.col("bytes") == F.col("_bytes"))
    run = F.element_at(F.expr("filter(runs, r -> r.first <= rank)"), -1)
    of_group = placed_by.select(F.col("_text").alias("_key"), "rank", run.alias("run")).select(
        "_key", F.expr("run.order[cast((rank - run.first) % size(run.order) as int)]").alias("shard"))
    placed = stored(rows.join(of_group, F.col("_text") == F.col("_key")).select(
        "doc_id", "size", "text_crc32", "_text", "shard", F.md5(F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("_text"))).alias("_order")), "shard-placed")
    out = ranked(placed, ["shard"], [F.col("_order"), F.col("doc_id"), F.col("_text")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
