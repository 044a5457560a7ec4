"""Retrieval queries: BM25, nearest neighbours, fusion, the evidence gate.

benchmark items are the questions. Vectors: rows of embeddings; vec_id is taken for doc_id where both are needed, and the queries are
the vectors whose id is divisible by 100.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text as X
from lodestack.functions import vectors as V
from lodestack.operators import bm25, evidence, hybrid, knn
from lodestack.operators.keyword_index import KeywordIndex
from lodestack.operators.pivots import PivotIndex
from lodestack.plans.library import CHUNKS_SQL, chunks, table
from lodestack.storage import keep, shared_dir

K = 20
TOKENS_SQL = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: NOT list_contains(string_split('" + " ".join(X.KEYWORD_STOPS) + r"', ' '), w))"
BM25_SQL = f"""
toks AS (SELECT scope, doc_id, {TOKENS_SQL} AS t FROM corpus),
stats AS (SELECT scope, count(*) AS n, avg(len(t)) AS avgdl FROM toks GROUP BY scope),
tf AS (SELECT scope, doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT scope, doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
df AS (SELECT scope, term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT DISTINCT query_id, unnest({TOKENS_SQL}) AS term FROM questions),
bm AS (
  SELECT scope, query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25_score
  FROM q JOIN tf USING (term) JOIN df USING (scope, term) JOIN stats USING (scope) GROUP BY ALL
)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def naming_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """questions, every third of which names an instrument that no document has."""
    named = F.when(F.col("query_id") % 3 == 0, F.concat("text", F.lit(" So says the 2031 Quantum Energy Act"))).otherwise(F.col("text"))
    return questions(spark, sf_dir).withColumn("text", named)


def corpus(spark: SparkSession, sf_dir: str, by_language: bool = False) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("scope") if by_language else F.lit("all").alias("scope"), "doc_id", "text")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    return rows.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vector", "label"), rows


def bm25_topk(spark, sf_dir):
    found = bm25.top(bm25.scores(corpus(spark, sf_dir), questions(spark, sf_dir)), K)
    return found.select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"), F.round("bm25_score", 6).alias("bm25_score"))


def kept_index(spark, sf_dir):
    """The five best of an index that was filled with the documents as they first were, and refreshed when a tenth had changed and others had gone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = KeywordIndex(spark, f"{shared_dir(spark)}/lodestack-{spark.sparkContext.applicationId}/keyword-index-{uuid.uuid4().hex}", n_buckets=16)
    index.refresh(docs.withColumn("changed", F.lit(1)))
    other = F.col("doc_id") % 10 == 0
    index.refresh(docs.where("doc_id % 17 <> 3").select("doc_id", F.when(other, F.reverse("text")).otherwise(F.col("text")).alias("text"), F.when(other, 2).otherwise(1).alias("changed")))
    return index.search(questions(spark, sf_dir), 5).select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"), F.round("bm25_score", 6).alias("bm25_score"))


def bm25_scoped(spark, sf_dir):
    found = bm25.top(bm25.scores(corpus(spark, sf_dir, True), questions(spark, sf_dir)), 5)
    return found.select("scope", "query_id", "doc_id", F.col("rank").cast("int").alias("rank"), F.round("bm25_score", 6).alias("bm25_score"))


def keyword_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", X.keyword_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def term_statistics(spark, sf_dir):
    tf = bm25.term_frequencies(corpus(spark, sf_dir), bm25.query_terms(questions(spark, sf_dir)))
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_chunks(spark, sf_dir):
    pages = chunks(table(spark, sf_dir, "documents")).select(F.lit("all").alias("scope"), F.struct("doc_id", "chunk_index").alias("doc_id"), "text")
    found = bm25.top(bm25.scores(pages, questions(spark, sf_dir)), 5)
    return found.select("query_id", "doc_id.doc_id", "doc_id.chunk_index", F.col("rank").cast("int").alias("rank"), F.round("bm25_score", 6).alias("bm25_score"))


def knn_topk(spark, sf_dir):
    queries, rows = vectors(spark, sf_dir)
    return PivotIndex(rows).nearest(queries, K).select("query_id", "doc_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("int").alias("rank"))


def knn_scoped(spark, sf_dir):
    """How many of a label are among the 50 nearest of the query's own label, and how far they reach: each label is searched by itself."""
    queries, rows = vectors(spark, sf_dir)
    found = knn.nearest(queries, rows, 50, scope="label")
    return found.groupBy("query_id").agg(F.count("*").alias("n_same_label"), F.round(F.min("distance"), 6).alias("nearest"), F.round(F.max("distance"), 6).alias("farthest"))


def knn_in_scope(spark, sf_dir):
    """The nearest of the query's own label: each label is searched by itself."""
    queries, rows = vectors(spark, sf_dir)
    return knn.nearest(queries, rows, K, scope="label").select("query_id", "doc_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("int").alias("rank"))


def vector_checks(spark, sf_dir):
    _, rows = vectors(spark, sf_dir)
    v = F.col("vector")
    return rows.select("doc_id", V.valid_vector(v, 64).alias("valid"), V.valid_vector(v, 63).alias("valid_63"), F.round(V.norm(v), 6).alias("norm"), F.round(V.cosine_distance(v, F.transform(v, lambda x: -x)), 6).alias("to_opposite"), F.round(V.cosine_similarity(v, F.transform(v, lambda x: x * 0)), 6).alias("to_zero"))


def fused(spark, sf_dir, limit=K, ask=questions):
    queries, rows = vectors(spark, sf_dir)
    dense = knn.nearest(queries, rows, K)
    asked = ask(spark, sf_dir).select((F.col("query_id") * 100).alias("query_id"), "text")
    sparse = bm25.top(bm25.scores(corpus(spark, sf_dir), asked), K).drop("scope")
    return queries, rows, hybrid.hybrid_candidates(dense, sparse, limit)


def rrf_fusion(spark, sf_dir):
    queries, rows, found = fused(spark, sf_dir)
    found = hybrid.backfill_distances(found, queries, rows)
    return found.select("query_id", "doc_id", F.round("distance", 6).alias("distance"), F.round("bm25_score", 6).alias("bm25_score"), F.round("rrf", 9).alias("rrf"), F.col("rank").cast("int").alias("rank"))


FUSED_SQL = f"""
WITH corpus AS (SELECT 'all' AS scope, doc_id, text FROM documents), questions AS (SELECT item_id * 100 AS query_id, text FROM benchmark), {BM25_SQL},
vq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
dist AS (SELECT query_id, vec_id AS doc_id, 1 - list_cosine_similarity(v, embedding::DOUBLE[]) AS distance FROM vq, embeddings),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS r FROM dist QUALIFY r <= 20),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25_score, 9) DESC, doc_id) AS r FROM bm WHERE query_id IN (SELECT query_id FROM dense) QUALIFY r <= 20),
merged AS (
  SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.doc_id, s.doc_id) AS doc_id, d.distance, s.bm25_score, d.r AS dr, s.r AS sr,
         coalesce(1.0::DOUBLE / (60.0::DOUBLE + d.r), 0::DOUBLE) + coalesce(1.0::DOUBLE / (60.0::DOUBLE + s.r), 0::DOUBLE) AS rrf
  FROM dense d FULL JOIN sparse s ON d.query_id = s.query_id AND d.doc_id = s.doc_id
),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, dr NULLS LAST, sr NULLS LAST) AS rank FROM merged QUALIFY rank <= 20),
filled AS (SELECT f.query_id, f.doc_id, coalesce(f.distance, x.distance, 1.0) AS distance, f.bm25_score, f.rrf, f.rank FROM fused f LEFT JOIN dist x ON x.query_id = f.query_id AND x.doc_id = f.doc_id)"""


def overlap_score(question, text):
    """A stand-in for a reranker: shared terms, less a constant; null where there is no text."""
    return F.when(text.isNotNull(), X.lexical_matches(question, text).cast("double") - F.lit(3.0))


def reranked(spark, sf_dir, ask=questions):
    queries, rows, found = fused(spark, sf_dir, ask=ask)
    found = hybrid.backfill_distances(found, queries, rows)
    asked = ask(spark, sf_dir).select((F.col("query_id") * 100).alias("query_id"), F.col("text").alias("question"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return hybrid.rerank(found.join(asked, "query_id").join(texts, "doc_id", "left"), overlap_score(F.col("question"), F.col("text")), 6)


def rerank_topk(spark, sf_dir):
    return reranked(spark, sf_dir).select("query_id", "doc_id", F.round("reranker_score", 6).alias("reranker_score"), F.col("new_rank").cast("int").alias("new_rank"))


EVIDENCE_STOPS_SQL = "string_split('" + " ".join(X.EVIDENCE_STOPS) + "', ' ')"
TERMS_SQL = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
QTERMS_SQL = f"list_filter({TERMS_SQL.format('question')}, lambda w: NOT list_contains({EVIDENCE_STOPS_SQL}, w))"
RERANK_SQL = f"""
scored AS (
  SELECT f.*, q.text AS question, d.text, len(list_intersect({QTERMS_SQL.replace("question", "q.text")}, {TERMS_SQL.format("d.text")})) - 3.0::DOUBLE AS reranker_score
  FROM filled f JOIN questions q USING (query_id) LEFT JOIN documents d ON d.doc_id = f.doc_id
),
top6 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(reranker_score, 9) DESC NULLS LAST, rank) AS new_rank FROM scored QUALIFY new_rank <= 6)"""


def gated(spark, sf_dir, ask=questions):
    rows = reranked(spark, sf_dir, ask)
    return rows.withColumn("relevant", evidence.is_relevant(F.col("question"), F.col("text"), F.col("distance"), F.col("reranker_score"), 0.6))


def evidence_chunks(spark, sf_dir):
    rows = gated(spark, sf_dir)
    return rows.select("query_id", "doc_id", X.lexical_matches(F.col("question"), F.col("text")).cast("long").alias("matches"), F.round(X.lexical_coverage(F.col("question"), F.col("text")), 6).alias("coverage"), "relevant")


RELEVANT_SQL = f"""
judged AS (
  SELECT *, len(list_intersect({QTERMS_SQL}, {TERMS_SQL.format("text")})) AS matches, len({QTERMS_SQL}) AS n_terms FROM top6
),
gate AS (
  SELECT *, coalesce(matches / nullif(n_terms, 0)::DOUBLE, 0) AS coverage,
    CASE WHEN coalesce(distance, 1) <= 0.6 THEN reranker_score IS NULL OR reranker_score >= -2
         ELSE matches >= 2 AND coalesce(matches / nullif(n_terms, 0)::DOUBLE, 0) >= 0.3
              AND CASE WHEN reranker_score IS NOT NULL THEN reranker_score >= -2 ELSE matches >= 3 AND coalesce(matches / nullif(n_terms, 0)::DOUBLE, 0) >= 0.6 END END AS relevant
  FROM judged
)"""


def contexts(rows, budget=3000):
    rows = rows.where("relevant").select("query_id", F.col("new_rank").alias("position"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file"), (F.col("doc_id") % 9 + 1).alias("page"), "text")
    return evidence.context(rows, budget)


def context_packing(spark, sf_dir):
    return contexts(gated(spark, sf_dir)).select("query_id", F.length("context").cast("long").alias("context_chars"), F.md5("context").alias("context_md5"), "truncated", "n_citations")


CONTEXT_SQL = """
blocks AS (SELECT query_id, new_rank AS position, '[' || new_rank || '] doc-' || doc_id || ', page ' || (doc_id % 9 + 1) || chr(10) || trim(text, ' ') AS block FROM gate WHERE relevant AND length(trim(coalesce(text, ''), ' ')) > 0),
room AS (SELECT *, 3000 - coalesce(sum(length(block)) OVER (PARTITION BY query_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM blocks QUALIFY left_ > 0),
ctx AS (SELECT query_id, string_agg(substring(block, 1, left_::BIGINT), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS context, bool_or(length(block) > left_) AS truncated, count(*) AS n_citations FROM room GROUP BY query_id)"""


def evidence_gate(spark, sf_dir):
    # written once: chunks and contexts both read it
    rows = keep(gated(spark, sf_dir, naming_questions), "gated")
    asked = naming_questions(spark, sf_dir).select((F.col("query_id") * 100).alias("query_id"), F.col("text").alias("question"), F.lit(True).alias("has_embeddings"))
    judged = rows.select("query_id", F.col("new_rank").alias("position"), "text", "distance", "reranker_score")
    return evidence.assess(asked, judged, contexts(rows), max_distance=0.6)


NAMING_SQL = "CASE WHEN item_id % 3 = 0 THEN text || ' So says the 2031 Quantum Energy Act' ELSE text END"
GATE_SQL = f"""
WITH {FUSED_SQL.strip()[5:].replace("text FROM benchmark", NAMING_SQL + " AS text FROM benchmark")}, {RERANK_SQL}, {RELEVANT_SQL}, {CONTEXT_SQL},
ev AS (SELECT query_id, count(*) FILTER (relevant) AS n_relevant, string_agg(coalesce(text, ''), chr(10) ORDER BY new_rank) FILTER (relevant) AS evidence FROM gate GROUP BY query_id),
named AS (
  SELECT q.query_id, unnest(range(1, 1 + len(names))) AS nth, unnest(names) AS name FROM (SELECT query_id, regexp_extract_all(q.text, '\\b((?:(?:[A-Z][A-Za-z0-9''’.-]*|\\d{{4}})\\s+){{1,7}}(?:Act|Bill|Regulations?|Standard|Framework|Policy|Plan))\\b', 1) AS names FROM questions q) q
),
unsupported AS (
  SELECT query_id, arg_min(name, nth) AS name FROM named LEFT JOIN ev USING (query_id) LEFT JOIN ctx USING (query_id)
  WHERE len(list_filter({TERMS_SQL.format("name")}, lambda t: NOT list_contains(string_split('{" ".join(X.GENERIC_INSTRUMENT_TERMS)}', ' '), t) AND NOT list_contains({TERMS_SQL.format("concat_ws(chr(10), context, evidence)")}, t))) > 0
  GROUP BY query_id
),
r AS (
  SELECT q.query_id, CASE WHEN coalesce(n_relevant, 0) = 0 THEN '{evidence.LOW_RELEVANCE}'
    WHEN name IS NOT NULL THEN 'The retrieved passages do not mention the explicitly named instrument "' || name || '".'
    WHEN length(trim(coalesce(context, ''), ' ')) < 200 THEN '{evidence.SHORT_CONTEXT}' END AS reason
  FROM questions q LEFT JOIN ev USING (query_id) LEFT JOIN ctx USING (query_id) LEFT JOIN unsupported USING (query_id)
)
SELECT query_id, reason IS NULL AS sufficient, reason FROM r"""


def citation_list(spark, sf_dir):
    rows = gated(spark, sf_dir).where("relevant").select("query_id", F.col("new_rank").alias("position"), "doc_id", (F.col("doc_id") % 9 + 1).alias("page"), "text")
    out = evidence.citations(rows)
    return out.select("query_id", F.col("number").cast("int").alias("number"), "doc_id", "page", F.md5("quote").alias("quote_md5"))


def question_validation(spark, sf_dir):
    """Benchmark items as candidate questions, in groups of eight; distances from the nearest vectors."""
    queries, rows = vectors(spark, sf_dir)
    near = knn.nearest(queries, rows.where("doc_id % 100 <> 0"), 3).select((F.floor(F.col("query_id") / 800)).alias("group_id"), (F.floor(F.col("query_id") / 100) % 8).alias("position"), "distance")
    asked = questions(spark, sf_dir).select(F.floor(F.col("query_id") / 8).alias("group_id"), (F.col("query_id") % 8).alias("position"), F.col("text").alias("question"))
    out = evidence.validate_questions(asked, near, 0.62, 2)
    return out.select("group_id", "position", F.round("best", 6).alias("best"), F.col("kept").cast("int").alias("kept"))


def web_evidence_gate(spark, sf_dir):
    """Pages as web results: their text in pieces of 600 characters, scored by shared terms with the item of the same number."""
    asked = questions(spark, sf_dir).select(F.col("query_id"), F.col("text").alias("question"))
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 40).alias("query_id"), "url", "page_id", text.alias("all"))
    pieces = pages.where("all <> ''").select("query_id", "url", "page_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("all") - 1) / 600).cast("int")), lambda k: F.substring(F.col("all"), k * 600 + 1, F.lit(600)))).alias("k", "text")).join(asked, "query_id")
    coverage = X.lexical_coverage(F.col("question"), F.col("text"))
    scored = pieces.select("query_id", "url", (F.col("page_id") * 100000 + F.col("k")).alias("ordinal"), "text", (F.lit(1.0) - coverage).alias("distance"), F.when(F.col("k") % 2 == 0, X.lexical_matches(F.col("question"), F.col("text")).cast("double")).alias("reranker_score"))
    return evidence.web_gate(scored, 0.95, 1.0).select("query_id", "url", F.round("distance", 6).alias("distance"), F.md5("text").alias("text_md5"), "passed")


WEB_SQL = f"""
WITH p AS (SELECT page_id % 40 AS query_id, url, page_id, trim(regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS body FROM pages),
c AS (SELECT query_id, url, page_id, k, substring(body, k * 600 + 1, 600) AS text, b.text AS question FROM (SELECT *, unnest(range(0, ((length(body) - 1) // 600 + 1)::BIGINT)) AS k FROM p WHERE body <> '') JOIN benchmark b ON b.item_id = query_id),
s AS (SELECT *, len(list_intersect({QTERMS_SQL}, {TERMS_SQL.format("text")})) AS m, len({QTERMS_SQL}) AS n FROM c),
d AS (SELECT *, 1.0::DOUBLE - coalesce(m / nullif(n, 0)::DOUBLE, 0) AS distance, CASE WHEN k % 2 = 0 THEN m END AS score FROM s)
SELECT query_id, url, round(distance, 6) AS distance, md5(text) AS text_md5, distance <= 0.95 AND coalesce(score >= 1, false) AS passed
FROM d QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY round(distance, 9), page_id * 100000 + k) = 1"""

CORPUS = "WITH corpus AS (SELECT @scope AS scope, doc_id, text FROM documents), questions AS (SELECT item_id AS query_id, text FROM benchmark), " + BM25_SQL

QUERIES = {
    "bm25_topk": bm25_topk,
    "b2_bm25_scoped": bm25_scoped,
    "b4_q4_kept_index": kept_index,
    "b1_keyword_tokens": keyword_tokens,
    "a5_term_statistics": term_statistics,
    "b3_bm25_chunks": bm25_chunks,
    "knn_topk": knn_topk,
    "v3_knn_scoped": knn_scoped,
    "v3_knn_in_scope": knn_in_scope,
    "v9_vector_checks": vector_checks,
    "rrf_fusion": rrf_fusion,
    "r4_rerank": rerank_topk,
    "e3_evidence_chunks": evidence_chunks,
    "e6_context_packing": context_packing,
    "e5_evidence_gate": evidence_gate,
    "e7_citations": citation_list,
    "e11_question_validation": question_validation,
    "e12_web_gate": web_evidence_gate,
}
RANKED = "SELECT {} FROM (SELECT *, row_number() OVER (PARTITION BY scope, query_id ORDER BY round(bm25_score, 9) DESC, doc_id) AS rank FROM bm) WHERE rank <= {}"
SQL = {
    "bm25_topk": CORPUS.replace("@scope", "'all'") + RANKED.format("query_id, doc_id, rank::INTEGER AS rank, round(bm25_score, 6) AS bm25_score", 20),
    "b2_bm25_scoped": CORPUS.replace("@scope", "lang") + RANKED.format("scope, query_id, doc_id, rank::INTEGER AS rank, round(bm25_score, 6) AS bm25_score", 5),
    "b4_q4_kept_index": "WITH corpus AS (SELECT 'all' AS scope, doc_id, CASE WHEN doc_id % 10 = 0 THEN reverse(text) ELSE text END AS text FROM documents WHERE doc_id % 17 <> 3), questions AS (SELECT item_id AS query_id, text FROM benchmark), " + BM25_SQL + RANKED.format("query_id, doc_id, rank::INTEGER AS rank, round(bm25_score, 6) AS bm25_score", 5),
    "b1_keyword_tokens": f"SELECT doc_id, len({TOKENS_SQL}) AS n_tokens, md5(array_to_string({TOKENS_SQL}, ' ')) AS tokens_md5 FROM documents",
    "a5_term_statistics": CORPUS.replace("@scope", "'all'") + "SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term",
    "b3_bm25_chunks": f"WITH {CHUNKS_SQL}, corpus AS (SELECT 'all' AS scope, {{'d': doc_id, 'c': chunk_index}} AS doc_id, text FROM chunks), questions AS (SELECT item_id AS query_id, text FROM benchmark), {BM25_SQL} " + RANKED.format("query_id, doc_id.d AS doc_id, doc_id.c AS chunk_index, rank::INTEGER AS rank, round(bm25_score, 6) AS bm25_score", 5),
    "knn_topk": """SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9), e.vec_id)::INTEGER AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 QUALIFY rank <= 20""",
    "v3_knn_scoped": """WITH t AS (SELECT q.vec_id AS query_id, q.label AS ql, e.label AS el, 1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d, e.vec_id AS doc_id
  FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(d, 9), e.vec_id) <= 50)
  SELECT query_id, count(*) AS n_same_label, round(min(d), 6) AS nearest, round(max(d), 6) AS farthest FROM t GROUP BY query_id""",
    "v3_knn_in_scope": """SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9), e.vec_id)::INTEGER AS rank
  FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 100 = 0 QUALIFY rank <= 20""",
    "v9_vector_checks": """SELECT vec_id AS doc_id, len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x) OR isinf(x))) AS valid, len(embedding) = 63 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x) OR isinf(x))) AS valid_63,
  round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, round(1 - list_cosine_similarity(embedding::DOUBLE[], list_transform(embedding::DOUBLE[], lambda x: -x)), 6) AS to_opposite, list_inner_product(embedding::DOUBLE[], list_transform(embedding::DOUBLE[], lambda x: x * 0)) AS to_zero FROM embeddings""",
    "rrf_fusion": FUSED_SQL + " SELECT query_id, doc_id, round(distance, 6) AS distance, round(bm25_score, 6) AS bm25_score, round(rrf, 9) AS rrf, rank::INTEGER AS rank FROM filled",
    "r4_rerank": f"{FUSED_SQL}, {RERANK_SQL} SELECT query_id, doc_id, round(reranker_score, 6) AS reranker_score, new_rank::INTEGER AS new_rank FROM top6",
    "e3_evidence_chunks": f"{FUSED_SQL}, {RERANK_SQL}, {RELEVANT_SQL} SELECT query_id, doc_id, coalesce(matches, 0)::BIGINT AS matches, round(coverage, 6) AS coverage, relevant FROM gate",
    "e6_context_packing": f"{FUSED_SQL}, {RERANK_SQL}, {RELEVANT_SQL}, {CONTEXT_SQL} SELECT query_id, length(context) AS context_chars, md5(context) AS context_md5, truncated, n_citations FROM ctx",
    "e5_evidence_gate": GATE_SQL,
    "e7_citations": f"{FUSED_SQL}, {RERANK_SQL}, {RELEVANT_SQL} SELECT query_id, new_rank::INTEGER AS number, doc_id, doc_id % 9 + 1 AS page, md5(left(text, 500)) AS quote_md5 FROM gate WHERE relevant",
    "e11_question_validation": """WITH d AS (SELECT q.vec_id AS query_id, min(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS best FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND e.vec_id % 100 <> 0 GROUP BY 1),
  c AS (SELECT item_id // 8 AS group_id, item_id % 8 AS position, best FROM benchmark JOIN d ON d.query_id = item_id * 100 WHERE best <= 0.62)
  SELECT group_id, position, round(best, 6) AS best, row_number() OVER (PARTITION BY group_id ORDER BY position)::INTEGER AS kept FROM c QUALIFY kept <= 2""",
    "e12_web_gate": WEB_SQL,
}
