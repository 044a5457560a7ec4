"""Sharding by Karmarkar-Karp differencing: equal texts stay together, shards get near-equal bytes.

Differencing takes the two partial partitions with the largest spread and adds them in opposite order, so their
differences cancel. Groups of equal texts that hold more than a fixed share of all bytes are differenced first; there are never more than
the share allows. The others are dealt by hash to buckets of bounded size, each differenced in its own task together with
the large groups' partition, scaled to the bucket: a bucket evens out its part of what the large groups left uneven. Every group is an item of
one differencing, at any size of the table.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.llm.common import documents, keep, starts

SHARDS = 40
ROW_BYTES = 16
#: A group of more than 1 / LARGE of all bytes is differenced before the others.
LARGE = 8000
#: Groups of a bucket, about.
BUCKET_GROUPS = 4000
ROWS_PER_BUCKET = 400


def difference(parts: np.ndarray) -> np.ndarray:
    """The shard of each slot: parts[i, j] is the weight of slot j of partial partition i, whose slots go to different shards.

    Returns an array of the same shape; each row is a permutation of the shards. Equal spreads are taken in the order given.
    """
    n, k = parts.shape
    first = np.argsort(-parts, axis=1, kind="stable")
    sums = list(np.take_along_axis(parts, first, 1))
    heap = [(-(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    made = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-(both[0] - both[-1]), len(sums)))
        made.append((a, b, order))
        sums.append(both)
    final = [None] * len(sums)
    if sums:
        final[-1] = np.arange(k)
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, order = made[node - n]
        final[a], final[b] = np.empty(k, np.int64), np.empty(k, np.int64)
        final[a][order] = final[node]
        final[b][k - 1 - order] = final[node]
        final[node] = None
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, first[i]] = final[i]
    return out


def _dealt(items: pd.DataFrame, shards: int, base: list[int] | None = None) -> pd.DataFrame:
    """(digest, shard, bytes) of items(digest, bytes), dealt beside a partition whose shards hold base."""
    items = items.sort_values(["bytes", "digest"], ascending=[False, True], ignore_index=True)
    parts = np.zeros((len(items) + 1, shards), np.int64)
    parts[0] = base if base is not None else 0
    parts[1:, 0] = items["bytes"]
    slots = difference(parts)
    # slot s of the base is shard s
    shard_of = np.empty(shards, np.int32)
    shard_of[slots[0]] = np.arange(shards)
    return pd.DataFrame({"digest": items["digest"], "shard": shard_of[slots[1:, 0]], "bytes": items["bytes"]})


def group_shards(groups: DataFrame, shards: int = SHARDS, large: int = LARGE, bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """(digest, shard) for groups(digest, bytes); a group is never divided.

    Less than `large` groups hold more than 1/large of all bytes: they are one task. What they leave uneven is the base of every bucket's differencing.
    """
    total = groups.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    n_buckets = max(1, -(-total["n"] // bucket_groups))
    out = "digest string, shard int, bytes long"
    own = F.col("bytes") > F.lit(total["bytes"] / large)
    first = keep(groups.where(own).select("digest", "bytes", F.lit(0).alias("all")).groupBy("all").applyInPandas(lambda p: _dealt(p[["digest", "bytes"]], shards), out), "shard-large")
    sums = {r["shard"]: r["bytes"] for r in first.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    base = [sums.get(k, 0) // n_buckets for k in range(shards)]
    bucket = F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).alias("bucket")
    rest = groups.where(~own).select("digest", "bytes", bucket).groupBy("bucket").applyInPandas(lambda p: _dealt(p[["digest", "bytes"]], shards, base), out)
    return first.unionByName(rest).select("digest", "shard")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each of docs(doc_id, text): size, text_crc32, law, shard, slot, grown_shard.

    The law is `bytes`: shards' sums of size (UTF-8 bytes plus 16) come as near as whole groups of equal texts allow. A null text has no
    bytes and is in the group of the empty ones. A group larger than a fair share stays whole, and its shard gets nothing else where that evens sums out. Slots number a
    shard's rows from 0 without gaps, by hash bucket, then doc_id (null first); rows equal in doc_id and text are numbered in either order.
    Empty tables give no rows; with few groups some shards stay empty.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest"))
    rows = keep(rows, "shard-rows")
    placed = keep(group_shards(keep(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-bytes"), shards), "shard-placed")
    n_buckets = max(1, -(-rows.count() // (shards * ROWS_PER_BUCKET)))
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_buckets))
    rows = keep(rows.join(placed, "digest").select("doc_id", "size", "text_crc32", "shard", bucket.alias("bucket")), "shard-dealt")
    counts = keep(rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")), "shard-counts")
    begin = keep(starts(counts, ["shard"], "n", n_buckets), "shard-starts")
    within = W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("nth", F.row_number().over(within) - 1).join(begin, ["shard", "bucket"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
