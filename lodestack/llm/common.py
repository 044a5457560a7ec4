"""What the operators share: tables, folds, connected components."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.storage import keep, shared_dir, small

__all__ = ["connected_components", "crc32_mod5", "documents", "fresh", "keep", "merged", "sent", "shared_dir", "starts"]

#: A running sum puts so many rows in one window at most.
FAN_OUT = 512
#: A table goes through the driver to every task up to so many rows.
SENT_ROWS = 20_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def merged(df: DataFrame) -> DataFrame:
    """df as a side of joins by shuffle and sort: Spark's own threshold is one of compressed bytes, and what is below it can be more than the driver's memory holds."""
    return df.hint("merge")


def sent(df: DataFrame) -> DataFrame:
    """The written table df as a side of joins: sent to every task if it has few rows, else merged."""
    out, fits = small(df, SENT_ROWS)
    return out if fits else merged(df)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each behind as many underscores as it takes to clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def crc32_mod5(doc_id):
    """crc32 of the id as text, modulo 5; 0 marks the held-out fold."""
    return F.crc32(doc_id.cast("string")) % 5


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps. Each step takes the least neighbour of every node by
    a partial aggregate and joins it back; no neighbour list is ever gathered, so a hub
    is only a skewed join, which adaptive execution splits. Edges are written after each step. What grows with them
    never goes through the driver.
    """
    edges = keep(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{name}-edges",
    )
    state = None
    while True:
        new = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if new == state or not new["n"]:
            break
        state = new
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = keep(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), f"{name}-least")
        large = both.join(sent(least), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = keep(large.where("a != b").distinct(), f"{name}-edges")
        # every edge now points from the larger to the smaller end
        least = keep(edges.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least")
        joined = edges.join(sent(least), "a")
        small = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = keep(small.where("a != b").distinct(), f"{name}-edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def starts(sums: DataFrame, keys: Sequence[str], value: str, n_buckets: int) -> DataFrame:
    """(keys, bucket, start) for sums(keys, bucket, value), one row for each: what the buckets before it, of the same keys, hold.

    Buckets are numbered from 0 to n_buckets - 1. FAN_OUT of them stand in a window; what stands before those comes from the
    sums of the windows, level by level, so no window grows with the table. Null keys count as equal.
    """
    if n_buckets <= FAN_OUT:
        return sums.select(*keys, "bucket", (F.sum(value).over(W.partitionBy(*keys).orderBy("bucket")) - F.col(value)).alias("start"))
    above = F.floor(F.col("bucket") / FAN_OUT).cast("long")
    level = sums.groupBy(*keys, above.alias("bucket")).agg(F.sum(value).alias(value))
    higher = starts(level, keys, value, -(-n_buckets // FAN_OUT)).withColumnRenamed("start", "before").alias("h")
    within = W.partitionBy(*keys, "above").orderBy("bucket")
    low = sums.withColumn("above", above).withColumn("run", F.sum(value).over(within) - F.col(value)).alias("l")
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys], F.col("l.above") == F.col("h.bucket"))
    return low.join(merged(higher), same).select(*[f"l.{k}" for k in keys], "l.bucket", (F.col("before") + F.col("run")).alias("start"))
