"""Scoped retrieval: each question's own documents by vectors and keywords, and the whole decision with its one relaxed retry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.functions.vectors import cosine_distance
from lodestack.operators import bm25, evidence, facets, filters, hybrid, knn
from lodestack.operators.scopes import Scopes
from lodestack.operators.scopes import scores as scoped_scores
from lodestack.storage import keep


def distances(pairs: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """pairs(query_id, doc_id) with distance; 1 where a vector is missing. queries(query_id, vector), corpus(doc_id, vector)."""
    q, c = queries.select("query_id", F.col("vector").alias("qv")), corpus.select("doc_id", F.col("vector").alias("cv"))
    rows = pairs.join(c, "doc_id", "left").join(q, "query_id", "left")
    return rows.withColumn("distance", F.coalesce(cosine_distance(F.col("qv"), F.col("cv")), F.lit(1.0))).drop("qv", "cv")


def nearest_in_scope(queries: DataFrame, corpus: DataFrame, scope: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, distance, rank): the k nearest of each query among the documents that scope(query_id, doc_id) gives it.

    Only rows of a scope meet: work and shuffle follow the scopes, which filters make small.
    """
    known = scope.join(corpus.select("doc_id"), "doc_id", "left_semi")
    order = W.partitionBy("query_id").orderBy(F.round("distance", 9), "doc_id")
    return distances(known, queries, corpus).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, corpus: DataFrame, wanted: DataFrame, docs: DataFrame | facets.FacetIndex, k: int) -> DataFrame:
    """nearest_in_scope where filters leave documents; where they leave none, or there are none, all documents in blocks."""
    index = docs if isinstance(docs, facets.FacetIndex) else facets.FacetIndex(docs)
    hit = keep(facets.hits(keep(wanted, "answer-wanted"), index), "answer-scope")
    rest = queries.join(wanted.select("query_id"), "query_id", "left_semi").join(hit.select("query_id").distinct(), "query_id", "left_anti")
    everywhere = knn.nearest(rest, corpus.join(index.docs.select("doc_id"), "doc_id", "left_semi"), k)
    columns = ["query_id", "doc_id", "distance", "rank"]
    return nearest_in_scope(queries, corpus, hit, k).select(*columns).unionByName(everywhere.select(*columns))


def candidates(asked: DataFrame, queries: DataFrame, corpus: DataFrame, found: DataFrame | None, scopes: Scopes, k: int) -> DataFrame:
    """The max(3k, 20) candidates of each question within its scope, by vectors and keywords: hybrid.rrf_merge's columns, distances filled in.

    asked(query_id, question), queries(query_id, vector), corpus(doc_id, vector). found: postings of the documents (bm25.postings or a kept index); None searches by vectors
    alone. A question without a neighbour has no candidates.
    """
    limit = hybrid.candidate_limit(k)
    near = knn.nearest(queries.join(scopes.of_query, "query_id"), scopes.rows(corpus.select("doc_id", "vector")), limit, scope="scope")
    near = keep(near.select("query_id", "doc_id", "distance", "rank"), "retrieve-dense")
    if found is None:
        return near.select("query_id", "doc_id", "distance", F.lit(None).cast("double").alias("bm25_score"), F.lit(None).cast("double").alias("rrf"), "rank")
    terms = keep(bm25.query_terms(asked.select("query_id", F.col("question").alias("text"))), "retrieve-terms")
    sparse = bm25.top(scoped_scores(found, terms, scopes), limit, by=("query_id",))
    return hybrid.backfill_distances(hybrid.hybrid_candidates(near, sparse, limit), queries, corpus)


def retrieve(asked: DataFrame, queries: DataFrame, corpus: DataFrame, texts: DataFrame, scopes: Scopes, k: int, score: Callable[[Column, Column], Column] | None = None, found: DataFrame | None = None, keywords: bool = True) -> DataFrame:
    """(query_id, question, doc_id, text, distance, bm25_score, reranker_score, new_rank): the k best of each question's candidates, reranked.

    texts(doc_id, text) are what keywords are searched in, unless found has their postings already. score(question, text) reranks; without it candidates stay in their order.
    keywords=False leaves the keyword search out.
    """
    texts = texts.select("doc_id", "text")
    if keywords and found is None:
        inside = texts.join(scopes.docs.select("doc_id"), "doc_id", "left_semi").select(F.lit("").alias("scope"), "doc_id", "text")
        found = keep(bm25.postings(inside, bm25.query_terms(asked.select("query_id", F.col("question").alias("text")))), "retrieve-postings")
    best = candidates(asked, queries, corpus, found if keywords else None, scopes, k)
    rows = best.join(asked.select("query_id", "question"), "query_id").join(texts, "doc_id", "left")
    return hybrid.rerank(rows, None if score is None else score(F.col("question"), F.col("text")), k)


def _decide(asked: DataFrame, rows: DataFrame, max_distance: float, budget: int) -> tuple[DataFrame, DataFrame]:
    rows = keep(rows.select("query_id", "question", "doc_id", "text", "distance", "reranker_score", F.col("new_rank").alias("rank")), "answer-rows")
    kept = rows.where(evidence.is_relevant(F.col("question"), F.col("text"), F.col("distance"), F.col("reranker_score"), max_distance))
    packed = evidence.context(kept.select("query_id", F.col("rank").alias("position"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file"), F.lit(None).cast("int").alias("page"), "text"), budget)
    judged = evidence.assess(asked.select("query_id", "question", F.lit(True).alias("has_embeddings")), rows.select("query_id", F.col("rank").alias("position"), "text", "distance", "reranker_score"), packed, max_distance=max_distance)
    return judged, kept


def answerable(
    asked: DataFrame,
    wanted: DataFrame,
    queries: DataFrame,
    corpus: DataFrame,
    docs: DataFrame,
    k: int,
    max_distance: float = evidence.MAX_DISTANCE,
    budget: int = evidence.CONTEXT_BUDGET,
    score: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(query_id, sufficient, reason, filter_applied, filter_fallback, n_kept) for asked(query_id, question).

    wanted: the questions' filters (see filters.infer). Each question is searched by vectors and keywords within what its filters leave, and reranked by score; regions
    that it names and no kept text serves make it insufficient. A question whose filters left documents that don't suffice is asked once more without filters, unless it names
    several regions.
    """
    docs = keep(docs.select("doc_id", "text", "policy_areas", "country_region", "source_organisation", "language", "keywords", "year"), "answer-docs")
    wanted, asked, index = keep(wanted, "answer-filters"), keep(asked.select("query_id", "question"), "answer-asked"), facets.FacetIndex(docs)
    corpus = corpus.join(docs.select("doc_id"), "doc_id", "left_semi")
    found = keep(bm25.postings(docs.select(F.lit("").alias("scope"), "doc_id", "text"), bm25.query_terms(asked.select("query_id", F.col("question").alias("text")))), "answer-postings")
    status = keep(filters.match_counts(wanted, index), "answer-status")
    judged, kept = _decide(asked, retrieve(asked, queries, corpus, docs, Scopes(wanted, index), k, score, found), max_distance, budget)
    regions = wanted.select("query_id", F.explode("country_regions").alias("region"))
    lacking = filters.missing_regions(regions, kept.select("query_id", "doc_id", "text"), docs).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("region")), ", ").alias("lacking"))
    counts = kept.groupBy("query_id").agg(F.count("*").alias("n_kept"))
    first = judged.join(lacking, "query_id", "left").join(status.select("query_id", "applied", "fallback"), "query_id").join(counts, "query_id", "left").join(wanted.select("query_id", F.size("country_regions").alias("n_regions")), "query_id")
    reason = F.when(F.col("lacking").isNotNull(), F.concat(F.lit("No relevant evidence was retrieved for every explicitly requested region. Missing: "), F.col("lacking"), F.lit("."))).otherwise(F.col("reason"))
    first = keep(first.withColumn("reason", reason).withColumn("sufficient", F.col("reason").isNull()), "answer-first")
    again = F.col("applied") & ~F.col("fallback") & ~F.col("sufficient") & (F.col("n_regions") <= 1)
    retried = first.where(again).select("query_id")
    relaxed = keep(asked.join(retried, "query_id", "left_semi"), "answer-relaxed")
    none = F.array().cast("array<string>")
    no_filters = wanted.join(retried, "query_id", "left_semi").select("query_id", *[none.alias(d) for d in facets.DIMENSIONS], *[F.lit(None).cast("int").alias(y) for y in ("year_from", "year_to")], F.lit(False).alias("freshness"))
    judged, kept = _decide(relaxed, retrieve(relaxed, queries, corpus, docs, Scopes(no_filters, index), k, score, found), max_distance, budget)
    second = judged.join(kept.groupBy("query_id").agg(F.count("*").alias("n_kept")), "query_id", "left").select("query_id", "sufficient", "reason", F.lit(True).alias("applied"), F.lit(True).alias("fallback"), "n_kept")
    out = first.where(~again).select("query_id", "sufficient", "reason", "applied", "fallback", "n_kept").unionByName(second)
    return out.select("query_id", "sufficient", "reason", F.col("applied").alias("filter_applied"), F.col("fallback").alias("filter_fallback"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"))
