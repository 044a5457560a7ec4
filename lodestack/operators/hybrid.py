"""Reciprocal-rank fusion of dense and keyword rankings, distance backfill, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def candidate_limit(k: int) -> int:
    """How many candidates are fetched before k are kept."""
    return max(3 * k, 20)


def rrf_merge(dense: DataFrame, sparse: DataFrame, limit: int, k: int = 60) -> DataFrame:
    """Fuse dense(query_id, doc_id, distance, rank) and sparse(query_id, doc_id, bm25_score, rank).

    Returns query_id, doc_id, distance, bm25_score, rrf, rank. Ranks count from 1. On equal sums dense candidates stand first in
    their order, then those of sparse alone. A candidate of sparse alone has no distance yet.
    """
    a = dense.select("query_id", "doc_id", "distance", F.col("rank").alias("dense_rank"))
    b = sparse.select("query_id", "doc_id", "bm25_score", F.col("rank").alias("sparse_rank"))
    share = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    both = a.join(b, ["query_id", "doc_id"], "full").withColumn("rrf", share("dense_rank") + share("sparse_rank"))
    order = W.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last())
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("dense_rank", "sparse_rank")


def hybrid_candidates(dense: DataFrame, sparse: DataFrame, limit: int, k: int = 60) -> DataFrame:
    """rrf_merge for queries that have dense candidates; a query without any stays without."""
    return rrf_merge(dense, sparse.join(dense.select("query_id").distinct(), "query_id", "left_semi"), limit, k)


def backfill_distances(fused: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Distances for fused rows without one, from vectors; 1 where there is no vector."""
    from lodestack.functions.vectors import cosine_distance

    q = queries.select("query_id", F.col("vector").alias("q_vector"))
    wanted = fused.where("distance is null").select("doc_id").distinct()
    c = corpus.select("doc_id", F.col("vector").alias("c_vector")).join(wanted, "doc_id", "left_semi")
    out = fused.join(q, "query_id", "left").join(c, "doc_id", "left")
    return out.withColumn("distance", F.coalesce("distance", cosine_distance(F.col("q_vector"), F.col("c_vector")), F.lit(1.0))).drop("q_vector", "c_vector")


def rerank(candidates: DataFrame, score: Column | None, limit: int) -> DataFrame:
    """The best by score, or, without a scorer, the first by rank; new_rank from 1. A null score stands last."""
    scored = candidates.withColumn("reranker_score", score if score is not None else F.lit(None).cast("double"))
    order = W.partitionBy("query_id").orderBy(F.round("reranker_score", 9).desc_nulls_last(), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= limit)
