"""Answering queries: visible and scoped search, the whole retrieval decision, ingest, and small display rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.functions import text as X
from lodestack.operators import evidence, facets, ingest, retrieve
from lodestack.operators.pivots import PivotIndex
from lodestack.operators.scopes import Scopes
from lodestack.plans.dialogue import EXPECT_SQL, MATCH_SQL, PHRASE_SQL, inferred
from lodestack.plans.library import LIBRARY_SQL, library, table, visible
from lodestack.plans.retrieval import EVIDENCE_STOPS_SQL, TERMS_SQL, TOKENS_SQL, overlap_score, vectors
from lodestack.sources import recorded
from lodestack.storage import shared_dir


def visible_neighbours(spark, sf_dir):
    """The ten nearest visible vectors; vec_id is the document."""
    queries, rows = vectors(spark, sf_dir)
    seen = library(spark, sf_dir).where(visible()).select("doc_id", F.coalesce("title", "original_filename").alias("display_title"), "source_organisation")
    found = PivotIndex(rows.join(seen, "doc_id", "left_semi")).nearest(queries, 10)
    return found.join(seen, "doc_id").select("query_id", "doc_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("int").alias("rank"), "display_title", "source_organisation")


def given_distances(spark, sf_dir):
    queries, rows = vectors(spark, sf_dir)
    pairs = table(spark, sf_dir, "embeddings").select((F.floor(F.col("vec_id") / 10) * 100).alias("query_id"), (F.col("vec_id") * 3).alias("doc_id"))
    return retrieve.distances(pairs, queries, rows).select("query_id", "doc_id", F.round("distance", 6).alias("distance"))


def asked_vectors(spark, sf_dir):
    """Question q is the vector of id 7q."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return rows.where("doc_id % 7 = 0").select((F.col("doc_id") / 7).cast("long").alias("query_id"), "vector"), rows


def scoped_search(spark, sf_dir):
    queries, rows = asked_vectors(spark, sf_dir)
    return retrieve.search(queries, rows, inferred(spark, sf_dir), library(spark, sf_dir), 5).select("query_id", "doc_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("int").alias("rank"))


def asked_items(spark, sf_dir):
    """Question q is benchmark item q; its filters are those of its phrase."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def scoped_hybrid(spark, sf_dir):
    """The five best of each question's candidates by vectors and keywords within its scope, reranked by shared terms."""
    queries, rows = asked_vectors(spark, sf_dir)
    docs = library(spark, sf_dir)
    scopes = Scopes(inferred(spark, sf_dir), facets.FacetIndex(docs))
    found = retrieve.retrieve(asked_items(spark, sf_dir), queries, rows, docs, scopes, 5, overlap_score)
    return found.select("query_id", "doc_id", F.round("distance", 6).alias("distance"), F.round("bm25_score", 6).alias("bm25_score"), F.round("reranker_score", 6).alias("reranker_score"), F.col("new_rank").cast("int").alias("rank"))


def decisions(spark, sf_dir):
    queries, rows = asked_vectors(spark, sf_dir)
    return retrieve.answerable(asked_items(spark, sf_dir), inferred(spark, sf_dir), queries, rows, library(spark, sf_dir), 5, 0.75, 2000, overlap_score)


def ingested(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    extracted = docs.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 9 != 1, F.array(F.struct(F.lit(1).alias("page"), F.when(F.col("doc_id") % 10 != 2, F.col("text")).otherwise(F.lit(" ")).alias("text")))).alias("pages"), F.when(F.col("doc_id") % 9 == 1, "broken file").alias("error"))
    known = docs.where("doc_id % 4 = 0").select("doc_id", X.normalised_hash(F.col("text")).alias("content_hash"))
    rows, _ = ingest.processed(extracted, known)
    return rows


def flags(spark, sf_dir):
    """Whether each table has rows, and whether any customer is in debt."""
    out = None
    for name, test in (("documents", F.lit(True)), ("pages", F.col("page_id") < 0), ("customer", F.col("c_acctbal") < 0)):
        one = table(spark, sf_dir, name).agg(F.coalesce(F.bool_or(test), F.lit(False)).alias("any")).select(F.lit(name).alias("name"), "any")
        out = one if out is None else out.unionByName(one)
    return out


def previews(spark, sf_dir):
    """Citations that aren't blank, three at most for each question."""
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("query_id"), "doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.col("text")).alias("quote"))
    # ranked first: partial ranks keep three of each question before anything is shuffled, and texts stay behind
    first = rows.where("trim(quote) <> ''").select("query_id", "doc_id").withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy("doc_id"))).where("nth <= 3")
    return first.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: i.cast("string")), ",").alias("shown"))


def displays(spark, sf_dir):
    i = F.col("p_partkey")
    label = F.when(i % 4 == 0, "智谱").when(i % 4 == 1, "未知模型").when(i % 4 == 2, "GLM 模型").otherwise(F.col("p_brand"))
    host = F.concat_ws(".", (i % 256).cast("string"), (i % 200).cast("string"), F.lit("1"), F.lit("9"))
    return table(spark, sf_dir, "part").select("p_partkey", X.english_display(label, X.humanized(F.lit("text_re-ranking"))).alias("display"), X.private_address(host).alias("private"))


def recorded_search(spark, sf_dir):
    """Pages as what a search service answered: page p stands at place p of topic p % 40, with some fields missing; asked again for 50 topics."""
    i = F.col("page_id")
    own = F.map_from_entries(F.array_compact(F.array(F.when(i % 3 == 0, F.struct(F.lit("title"), F.concat(F.lit("Own "), i.cast("string")))), F.when(i % 4 == 1, F.struct(F.lit("description"), F.concat(F.lit("About "), i.cast("string")))), F.when(i % 5 == 2, F.struct(F.lit("source_url"), F.concat(F.lit("https://source/"), i.cast("string")))))))
    items = table(spark, sf_dir, "pages").select(F.concat(F.lit("topic "), (i % 40).cast("string")).alias("query"), i.cast("int").alias("position"), "url", F.when(i % 2 == 0, F.concat(F.lit("Page "), i.cast("string"))).alias("title"), F.when(i % 4 != 1, F.col("html")).alias("markdown"), F.lit(None).cast("string").alias("description"), own.alias("metadata"))
    path = f"{shared_dir(spark)}/lodestack-{spark.sparkContext.applicationId}/recorded-{uuid.uuid4().hex}"
    recorded.record(items, path)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("topic "), (F.col("item_id") % 50).cast("string")).alias("query"))
    return recorded.search(spark, path, asked).select("query_id", F.col("rank").cast("int").alias("rank"), "url", "title", F.md5("content").alias("content_md5"))


QUERIES = {
    "s11_recorded_search": recorded_search, "v4_j3_visible_neighbours": visible_neighbours, "v7_j12_distances": given_distances, "v3_p7_scoped_search": scoped_search, "r5_scoped_hybrid": scoped_hybrid, "e8_decisions": decisions, "d1_ingest": ingested,
    "a15_flags": flags, "p15_citation_preview": previews, "f17_d20_display": displays,
}

ASKED_SQL = f"WITH {PHRASE_SQL}, {EXPECT_SQL}, {LIBRARY_SQL.strip()}, hit AS (SELECT f.query_id, d.doc_id FROM expected f JOIN library d ON {MATCH_SQL}), scope AS (SELECT * FROM hit UNION ALL SELECT q.query_id, d.doc_id FROM questions q, library d WHERE q.query_id NOT IN (SELECT query_id FROM hit))"

def hybrid_sql(p: str, scope: str) -> str:
    """The tables of a search within scope(query_id, doc_id), named with a prefix; the last is {p}best."""
    return f"""
{p}lens AS (SELECT s.query_id, count(*) AS n, avg(len(t)) AS avgdl FROM {scope} s JOIN toks USING (doc_id) GROUP BY 1),
{p}rows AS (SELECT s.query_id, s.doc_id, term, tf, dl FROM {scope} s JOIN qterms USING (query_id) JOIN tfs USING (doc_id, term)),
{p}df AS (SELECT query_id, term, count(*) AS df FROM {p}rows GROUP BY ALL),
{p}bm AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25_score FROM {p}rows JOIN {p}df USING (query_id, term) JOIN {p}lens USING (query_id) GROUP BY ALL),
{p}dense AS (SELECT s.query_id, s.doc_id, distance, row_number() OVER (PARTITION BY s.query_id ORDER BY round(distance, 9), s.doc_id) AS r FROM {scope} s JOIN dist USING (query_id, doc_id) QUALIFY r <= 20),
{p}sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25_score, 9) DESC, doc_id) AS r FROM {p}bm WHERE query_id IN (SELECT query_id FROM {p}dense) QUALIFY r <= 20),
{p}merged AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.doc_id, s.doc_id) AS doc_id, s.bm25_score, d.r AS dr, s.r AS sr, coalesce(1.0::DOUBLE / (60.0::DOUBLE + d.r), 0::DOUBLE) + coalesce(1.0::DOUBLE / (60.0::DOUBLE + s.r), 0::DOUBLE) AS rrf FROM {p}dense d FULL JOIN {p}sparse s ON d.query_id = s.query_id AND d.doc_id = s.doc_id),
{p}fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, dr NULLS LAST, sr NULLS LAST) AS rank FROM {p}merged QUALIFY rank <= 20),
{p}scored AS (SELECT f.query_id, f.doc_id, coalesce(x.distance, 1.0) AS distance, f.bm25_score, q.question, d.text, f.rank, len(list_intersect(q.terms, d.terms)) AS matches, len(q.terms) AS n_terms FROM {p}fused f JOIN asked q USING (query_id) JOIN texts d ON d.doc_id = f.doc_id LEFT JOIN dist x ON x.query_id = f.query_id AND x.doc_id = f.doc_id),
{p}best AS (SELECT *, matches - 3.0::DOUBLE AS reranker_score, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, rank) AS new_rank FROM {p}scored QUALIFY new_rank <= 5)"""


def judged_sql(p: str) -> str:
    """The tables that judge {p}best of questions {p}asked(query_id); the last is {p}judged(query_id, reason, n_kept)."""
    return f"""
{p}gate AS (SELECT *, coalesce(matches / nullif(n_terms, 0)::DOUBLE, 0) AS coverage, CASE WHEN distance <= 0.75 THEN reranker_score >= -2 ELSE matches >= 2 AND coalesce(matches / nullif(n_terms, 0)::DOUBLE, 0) >= 0.3 AND reranker_score >= -2 END AS relevant FROM {p}best),
{p}blocks AS (SELECT query_id, new_rank AS position, '[' || new_rank || '] doc-' || doc_id || chr(10) || trim(text, ' ') AS block FROM {p}gate WHERE relevant AND length(trim(coalesce(text, ''), ' ')) > 0),
{p}room AS (SELECT *, 2000 - coalesce(sum(length(block)) OVER (PARTITION BY query_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM {p}blocks QUALIFY left_ > 0),
{p}ctx AS (SELECT query_id, string_agg(substring(block, 1, left_::BIGINT), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS context FROM {p}room GROUP BY 1),
{p}judged AS (SELECT a.query_id, coalesce(n_kept, 0) AS n_kept, CASE WHEN coalesce(n_kept, 0) = 0 THEN '{evidence.LOW_RELEVANCE}' WHEN length(trim(coalesce(context, ''), ' ')) < 200 THEN '{evidence.SHORT_CONTEXT}' END AS reason FROM {p}asked a LEFT JOIN (SELECT query_id, count(*) AS n_kept FROM {p}gate WHERE relevant GROUP BY 1) USING (query_id) LEFT JOIN {p}ctx USING (query_id))"""


# Questions name no instrument here, so that reason is left out; e5_evidence_gate has it.
SEARCH_SQL = f"""{ASKED_SQL},
asked AS (SELECT item_id AS query_id, text AS question, list_filter({TERMS_SQL.format("text")}, lambda w: NOT list_contains({EVIDENCE_STOPS_SQL}, w)) AS terms FROM benchmark),
texts AS (SELECT doc_id, text, {TERMS_SQL.format("text")} AS terms FROM library),
toks AS (SELECT doc_id, {TOKENS_SQL} AS t FROM library), tfs AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
qterms AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS_SQL}) AS term FROM benchmark),
dist AS (SELECT q.vec_id // 7 AS query_id, e.vec_id AS doc_id, 1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 7 = 0),
{hybrid_sql("a_", "scope").strip()}"""

HASH_SQL = "sha256(lower(trim(regexp_replace({}, '\\s+', ' ', 'g'), ' ')))"
LANG_SQL = "CASE WHEN regexp_matches(lower(left(t, 20000)), 'transformaci|polit|digitalizaci') THEN 'Spanish' WHEN regexp_matches(lower(left(t, 20000)), 'strat|numer|gouvernance') THEN 'French' ELSE 'English' END"

SQL = {
    "s11_recorded_search": "WITH i AS (SELECT page_id AS p, 'topic ' || (page_id % 40) AS query, CASE WHEN page_id % 5 = 2 THEN 'https://source/' || page_id ELSE url END AS link, url, html FROM pages), b AS (SELECT item_id AS query_id, 'topic ' || (item_id % 50) AS query FROM benchmark) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY p)::INTEGER AS rank, link AS url, CASE WHEN p % 3 = 0 THEN 'Own ' || p WHEN p % 2 = 0 THEN 'Page ' || p ELSE link END AS title, md5(CASE WHEN p % 4 = 1 THEN 'About ' || p ELSE coalesce(html, '') END) AS content_md5 FROM b JOIN i USING (query) QUALIFY rank <= 5",
    "v4_j3_visible_neighbours": f"WITH {LIBRARY_SQL.strip()}, d AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, 1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance, coalesce(title, original_filename) AS display_title, source_organisation FROM embeddings q, embeddings e JOIN library l ON l.doc_id = e.vec_id WHERE q.vec_id % 100 = 0 AND approved AND access_level = 'public') SELECT query_id, doc_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id)::INTEGER AS rank, display_title, source_organisation FROM d QUALIFY rank <= 10",
    "v7_j12_distances": "WITH p AS (SELECT vec_id // 10 * 100 AS query_id, vec_id * 3 AS doc_id FROM embeddings) SELECT p.query_id, p.doc_id, round(coalesce(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 1), 6) AS distance FROM p LEFT JOIN embeddings q ON q.vec_id = p.query_id AND q.vec_id % 100 = 0 LEFT JOIN embeddings e ON e.vec_id = p.doc_id",
    "v3_p7_scoped_search": ASKED_SQL + ", d AS (SELECT s.query_id, s.doc_id, 1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance FROM scope s JOIN embeddings e ON e.vec_id = s.doc_id JOIN embeddings q ON q.vec_id = s.query_id * 7) SELECT query_id, doc_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id)::INTEGER AS rank FROM d QUALIFY rank <= 5",
    "r5_scoped_hybrid": f"{SEARCH_SQL} SELECT query_id, doc_id, round(distance, 6) AS distance, round(bm25_score, 6) AS bm25_score, reranker_score, new_rank::INTEGER AS rank FROM a_best",
    "e8_decisions": f"""{SEARCH_SQL}, a_asked AS (SELECT query_id FROM asked), {judged_sql("a_").strip()},
lacking AS (SELECT query_id, string_agg(region, ', ' ORDER BY region) AS lacking FROM (SELECT query_id, unnest(country_regions) AS region FROM expected) r WHERE NOT EXISTS (SELECT 1 FROM a_gate g JOIN library l USING (doc_id) WHERE g.query_id = r.query_id AND g.relevant AND (l.country_region = r.region OR contains(lower(l.text), lower(r.region)))) GROUP BY 1),
first AS (SELECT query_id, CASE WHEN lacking IS NOT NULL THEN 'No relevant evidence was retrieved for every explicitly requested region. Missing: ' || lacking || '.' ELSE reason END AS reason, k <> 7 AS applied, k <> 7 AND query_id NOT IN (SELECT query_id FROM hit) AS fallback, n_kept, len(country_regions) AS n_regions FROM a_judged JOIN expected USING (query_id) LEFT JOIN lacking USING (query_id)),
b_asked AS (SELECT query_id FROM first WHERE applied AND NOT fallback AND reason IS NOT NULL AND n_regions <= 1),
wide AS (SELECT query_id, doc_id FROM b_asked, library), {hybrid_sql("b_", "wide").strip()}, {judged_sql("b_").strip()}
SELECT query_id, reason IS NULL AS sufficient, reason, applied AS filter_applied, fallback AS filter_fallback, n_kept FROM first WHERE query_id NOT IN (SELECT query_id FROM b_asked)
UNION ALL SELECT query_id, reason IS NULL, reason, true, true, n_kept FROM b_judged""",
    "d1_ingest": f"WITH x AS (SELECT doc_id, doc_id % 9 = 1 AS broken, CASE WHEN doc_id % 9 = 1 THEN '' WHEN doc_id % 10 = 2 THEN ' ' ELSE text END AS t FROM documents WHERE doc_id % 4 <> 0), h AS (SELECT *, CASE WHEN trim(t, ' ') <> '' THEN {HASH_SQL.format('t')} END AS content_hash FROM x), k AS (SELECT {HASH_SQL.format('text')} AS content_hash, min(doc_id) AS duplicate_of FROM documents WHERE doc_id % 4 = 0 GROUP BY 1) SELECT doc_id, CASE WHEN content_hash IS NULL THEN 'failed' ELSE 'ready' END AS status, CASE WHEN broken THEN 'broken file' WHEN content_hash IS NULL THEN 'no extractable text' END AS error, h.content_hash, CASE WHEN content_hash IS NOT NULL THEN {LANG_SQL} END AS language, CASE WHEN broken THEN 0 ELSE 1 END::INTEGER AS page_count, duplicate_of FROM h LEFT JOIN k USING (content_hash)",
    "a15_flags": "SELECT 'documents' AS name, count(*) > 0 AS any FROM documents UNION ALL SELECT 'pages', coalesce(bool_or(page_id < 0), false) FROM pages UNION ALL SELECT 'customer', coalesce(bool_or(c_acctbal < 0), false) FROM customer",
    "p15_citation_preview": "WITH r AS (SELECT doc_id % 40 AS query_id, doc_id FROM documents WHERE doc_id % 3 <> 0 AND trim(text, ' ') <> '' QUALIFY row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) <= 3) SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS shown FROM r GROUP BY 1",
    "f17_d20_display": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Zhipu' WHEN 1 THEN 'Text Re Ranking' WHEN 2 THEN 'GLM 模型' ELSE p_brand END AS display, a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 198 AND b IN (18, 19)) AS private FROM (SELECT *, p_partkey % 256 AS a, p_partkey % 200 AS b FROM part)",
}
