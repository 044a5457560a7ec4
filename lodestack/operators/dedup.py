"""Document dedup as the library does it: bytes, normalised text, regions of vectors, URL, cleanup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.functions.text import normalised_hash
from lodestack.operators.pivots import PivotIndex


def with_hashes(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"sha256": F.sha2("text", 256), "content_hash": normalised_hash(F.col("text"))})


def groups(docs: DataFrame, key: str) -> DataFrame:
    return docs.groupBy(key).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def keep_report(docs: DataFrame, key: str, completeness: str) -> DataFrame:
    """(doc_id, key, action) of every document in a group of equal keys: the most complete stays, then the earliest upload, then the id.

    The keeper comes from an aggregate, so a group of any size is no single task.
    """
    best = F.min_by("doc_id", F.struct((-F.col(completeness)).alias("c"), "uploaded_at", "doc_id"))
    keepers = docs.groupBy(key).agg(F.count("*").alias("n"), best.alias("keep_id")).where("n > 1")
    return docs.join(keepers, key).select("doc_id", key, "keep_id", F.when(F.col("doc_id") == F.col("keep_id"), "keep").otherwise("remove").alias("action"))


def semantic_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, window, text): start, middle and end of trimmed texts of 1,200 characters or more; equal windows once."""
    text = F.trim("text")
    n = F.length(text)
    size = F.least(F.lit(2000), F.greatest(F.lit(600), F.floor(n / 4).cast("int")))
    starts = F.array(F.lit(0), F.greatest(F.lit(0), F.floor((n - size) / 2).cast("int")), F.greatest(F.lit(0), n - size))
    cut = docs.where(n >= 1200).select("doc_id", F.posexplode(F.array_distinct(F.transform(starts, lambda s: F.substring(text, s + 1, size)))).alias("window", "text"))
    return cut


def semantic_duplicates(windows: DataFrame, corpus: DataFrame, max_distance: float = 0.05, k: int = 8) -> DataFrame:
    """(doc_id, duplicate_of, total_distance): the candidate that all windows of a document find, with the least sum of distances.

    windows(doc_id, window, vector), two at least for each document; corpus(doc_id, owner, vector): a vector and its document. A window finds the k nearest of those
    within max_distance: blocks of vectors that can't be so near aren't read.
    """
    asked = windows.select((F.col("doc_id") * 3 + F.col("window")).alias("query_id"), "vector")
    found = PivotIndex(corpus.select("doc_id", "vector")).within(asked, max_distance, k)
    found = found.join(corpus.select("doc_id", "owner"), "doc_id").select(F.floor(F.col("query_id") / 3).alias("doc_id"), (F.col("query_id") % 3).alias("window"), "owner", "distance").where("owner <> doc_id")
    near = found.groupBy("doc_id", "window", "owner").agg(F.min("distance").alias("distance"))
    counts = windows.groupBy("doc_id").agg(F.count("*").alias("n_windows")).where("n_windows >= 2")
    shared = near.groupBy("doc_id", "owner").agg(F.count("*").alias("n"), F.sum("distance").alias("total_distance")).join(counts, "doc_id").where("n = n_windows")
    return shared.groupBy("doc_id").agg(F.min_by(F.struct("owner", "total_distance"), F.struct(F.round("total_distance", 9), "owner")).alias("b")).select("doc_id", F.col("b.owner").alias("duplicate_of"), "b.total_distance")


def url_owners(urls: DataFrame, docs: DataFrame) -> DataFrame:
    """(url, doc_id) of docs(doc_id, canonical_url, source_url, uploaded_at): the canonical owner first, then the oldest."""
    canonical = docs.where("canonical_url is not null").select(F.col("canonical_url").alias("url"), F.lit(0).alias("tier"), "doc_id", "uploaded_at")
    legacy = docs.where("source_url is not null").select(F.col("source_url").alias("url"), F.lit(1).alias("tier"), "doc_id", "uploaded_at")
    best = canonical.unionByName(legacy).groupBy("url").agg(F.min_by("doc_id", F.struct("tier", "uploaded_at", "doc_id")).alias("doc_id"))
    return urls.join(best, "url", "left")


def import_decision(arrivals: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, existing_id, layer): what each of arrivals(doc_id, url, sha256, content_hash) duplicates in known, by URL, then bytes, then normalised text."""
    out = arrivals.select("doc_id", "url", "sha256", "content_hash")
    for key, name in (("url", "url_id"), ("sha256", "l1_id"), ("content_hash", "l2_id")):
        out = out.join(known.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("doc_id").alias(name)), key, "left")
    layer = F.when(F.col("url_id").isNotNull(), "url").when(F.col("l1_id").isNotNull(), "bytes").when(F.col("l2_id").isNotNull(), "text").otherwise("new")
    return out.select("doc_id", F.coalesce("url_id", "l1_id", "l2_id").alias("existing_id"), layer.alias("layer"))


def clean_candidates(candidates: DataFrame, history: DataFrame, originals: DataFrame, max_chars: int = 140, pool: int = 8) -> DataFrame:
    """Suggested questions without repeats: candidates(group_id, position, text) whose key is new to history(group_id, text) and originals(group_id, text)."""
    from lodestack.functions.text import question_key

    clean = F.trim("text")
    short = F.when(F.length(clean) > max_chars, F.rtrim(F.substring(clean, 1, max_chars))).otherwise(clean)
    rows = candidates.withColumn("text", short).withColumn("key", question_key(F.col("text"))).where("key <> ''")
    known = history.select("group_id", question_key(F.col("text")).alias("key")).unionByName(originals.select("group_id", question_key(F.col("text")).alias("key"))).distinct()
    fresh = rows.join(known, ["group_id", "key"], "left_anti")
    first = fresh.withColumn("nth", F.row_number().over(W.partitionBy("group_id", "key").orderBy("position"))).where("nth = 1")
    return first.withColumn("kept", F.row_number().over(W.partitionBy("group_id").orderBy("position"))).where(F.col("kept") <= pool).select("group_id", "kept", "text")
