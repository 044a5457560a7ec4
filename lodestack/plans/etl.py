"""Document ETL queries. The pages of a document are its text in pieces of 1,000 characters, each with a running header and footer."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import text as X
from lodestack.functions import vectors as V
from lodestack.operators import etl
from lodestack.plans.library import CHUNKS_SQL, LIBRARY_SQL, chunks, library, table
from lodestack.streaming import ingest, threads


def pages(spark, sf_dir):
    rows = chunks(table(spark, sf_dir, "documents"))
    head = F.concat(F.lit("Annual  Report "), F.col("doc_id").cast("string"), F.lit("\n"))
    foot = F.concat(F.lit("\nPage "), (F.col("chunk_index") + 1).cast("string"))
    ref = F.when((F.col("chunk_index") >= 4) & (F.col("doc_id") % 2 == 0), F.lit("\nReferences\n")).otherwise(F.lit("\n"))
    return rows.select("doc_id", F.col("chunk_index").alias("page"), F.concat(head, F.substring("text", 1, 500), ref, F.substring("text", 501, 500), foot).alias("text"))


def margin_lines(spark, sf_dir):
    return etl.repeated_margin_lines(pages(spark, sf_dir))


def cleaned(spark, sf_dir):
    out = etl.clean_pages(pages(spark, sf_dir))
    return out.select("doc_id", "page", F.length("text").cast("long").alias("chars"))


def chunked(spark, sf_dir):
    """Lines are paragraphs here; budget 128 words, overlap 16."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array(F.struct(F.lit(1).alias("page"), F.regexp_replace("text", "\n", "\n\n").alias("text"))).alias("pages"))
    return etl.chunk(docs, 128, 16).select("doc_id", "chunk_index", "token_count", F.md5("text").alias("text_md5"))


def excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(X.excerpt(F.col("text"))).cast("long").alias("chars"), F.md5(X.excerpt(F.col("text"))).alias("excerpt_md5"), X.heuristic_language(F.col("text")).alias("language"))


def answers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    body = F.concat(F.lit('{"title": "T'), F.col("event_id").cast("string"), F.lit('", "year": "'), F.when(F.col("event_id") % 3 == 0, "n.d.").otherwise((F.col("event_id") % 50 + 1980).cast("string")), F.lit('", "publication_date": "'), F.when(F.col("event_id") % 4 == 0, "2024-13-01").otherwise("2024-02-03"), F.lit('", "keywords": [" a ", "", "'), F.col("event_type"), F.lit('"]}'))
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("event_id") % 5 == 1, F.concat(F.lit("Sure: "), body, F.lit(" done"))).when(F.col("event_id") % 5 == 2, F.lit("no json here")).otherwise(body)
    return e.select(F.col("event_id").alias("doc_id"), raw.alias("raw"), F.concat(F.lit("file-"), F.col("event_id").cast("string")).alias("fallback"))


def metadata_json(spark, sf_dir):
    out = etl.clean_metadata(answers(spark, sf_dir), "raw", "fallback")
    return out.select("doc_id", "title", "year", F.col("publication_date").cast("string").alias("publication_date"), F.array_join("keywords", ",").alias("keywords"))


def string_recovery(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.concat(F.lit('["Q '), F.col("event_type"), F.lit('", " ", "two \\"x\\" '), F.col("user_id").cast("string"), F.lit('", "cut'))
    listed = F.when(F.col("event_id") % 3 == 0, F.lit("a;b, c; ")).when(F.col("event_id") % 3 == 1, F.lit("a, b,,c")).otherwise(F.lit("a\nb;c\n"))
    return e.select("event_id", F.array_join(etl.recovered_strings(raw), "|").alias("recovered"), F.array_join(etl.string_to_list(listed), "|").alias("listed"), X.masked_secret(F.concat(F.lit("key-"), F.repeat(F.lit("x"), (F.col("event_id") % 7).cast("int")), F.col("user_id").cast("string"))).alias("masked"), X.lossy_title(F.when(F.col("event_id") % 2 == 0, "a ???").otherwise("a??")).alias("lossy"))


def label_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    values = rows.select(F.floor(F.col("vec_id") / 5).alias("doc_id"), (F.col("vec_id") % 5).alias("position"), F.concat(F.lit("l"), (F.col("vec_id") % 13).cast("string")).alias("value"), F.col("embedding").alias("vector"))
    # one leaf label for each of the ten labels: its vector of least id
    leaves = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(F.col("label").cast("long").alias("label_id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("label"), "vector")
    return values, leaves


def snapped_labels(spark, sf_dir):
    values, leaves = label_vectors(spark, sf_dir)
    return etl.nearest_labels(values, leaves, 0.4, 3).select("doc_id", F.array_join("labels", ",").alias("labels"))


def taxonomy_labels(spark, sf_dir):
    values, leaves = label_vectors(spark, sf_dir)
    return etl.exact_labels(values, leaves, 3).select("doc_id", F.array_join("labels", ",").alias("labels"))


def embedding_inputs(spark, sf_dir):
    docs = library(spark, sf_dir)
    text = etl.embedding_input(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  About\n"), "original_filename", F.lit(" "), F.repeat("source_type", 60))), F.col("text"))
    return docs.select("doc_id", F.md5(text).alias("input_md5"), etl.infer_chunk_language(F.when(F.col("doc_id") % 3 == 0, "detected"), F.col("language"), F.col("text")).alias("language"))


def vector_literals(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.vector_literal(F.col("embedding")).alias("literal"))
    return rows.select("vec_id", F.length("literal").cast("long").alias("chars"), F.md5("literal").alias("literal_md5"))


def content_checks(spark, sf_dir):
    docs = library(spark, sf_dir)
    raw = F.when(F.col("doc_id") % 8 == 0, F.encode(F.lit("%PDF-1.7"), "UTF-8")).when(F.col("doc_id") % 8 == 1, F.unhex(F.lit("504B030414"))).when(F.col("doc_id") % 8 == 2, F.unhex(F.lit("4100"))).when(F.col("doc_id") % 8 == 3, F.unhex(F.lit("FFFE41"))).otherwise(F.encode("summary", "UTF-8"))
    path = F.concat(F.lit("C:\\up/load/"), F.col("original_filename"), F.when(F.col("doc_id") % 5 == 0, ".exe").otherwise(""))
    return docs.select("doc_id", X.valid_content(F.col("original_filename"), raw).alias("valid"), X.safe_filename(path).alias("filename"), X.mime_type(path).alias("mime_type"))


def windows(spark, sf_dir):
    return ingest.event_windows(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


def folded(spark, sf_dir):
    """Each user's event count, errors since the last other event, and last event."""
    kind = F.when(F.col("event_type") == "error", "error").otherwise("reset")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("thread"), F.col("event_id").alias("seq"), kind.alias("kind"), F.lit(None).cast("string").alias("key"))
    return threads.states(events, ("reset",)).select(F.col("thread").alias("user_id"), "n", F.col("since").alias("errors"), "last")


def thread_states(spark, sf_dir):
    """Users as threads: a purchase begins a turn, a click calls a tool, a view opens a page."""
    kind = F.when(F.col("event_type") == "purchase", "question").when(F.col("event_type") == "click", "tool").when(F.col("event_type") == "view", "page").otherwise("other")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("thread"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("k"), (F.floor(F.col("value")) % 11).cast("string")).alias("key"))
    return threads.states(events, ("question",), 4)


QUERIES = {
    "d2_margin_lines": margin_lines, "d3_d4_clean_pages": cleaned, "d5_d8_chunks": chunked, "d12_d13_excerpts": excerpts, "d14_metadata_json": metadata_json, "f9_f16_strings": string_recovery,
    "v5_j17_snapped_labels": snapped_labels, "d15_taxonomy_labels": taxonomy_labels, "d10_d11_embedding_input": embedding_inputs, "v10_vector_literal": vector_literals, "s2_s4_content_checks": content_checks,
    "event_windows": windows, "q6_folded_state": folded, "q6_thread_states": thread_states,
}

PAGES_SQL = f"{CHUNKS_SQL}, pages_ AS (SELECT doc_id, chunk_index AS page, 'Annual  Report ' || doc_id || chr(10) || left(text, 500) || CASE WHEN chunk_index >= 4 AND doc_id % 2 = 0 THEN chr(10) || 'References' || chr(10) ELSE chr(10) END || substring(text, 501, 500) || chr(10) || 'Page ' || (chunk_index + 1) AS text FROM chunks)"
NOISE_SQL = "regexp_replace(lower(trim(regexp_replace({}, '\\s+', ' ', 'g'), ' ')), '[0-9]+', '#', 'g')"
MARGIN_SQL = f"lines AS (SELECT doc_id, page, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM pages_), margin AS (SELECT doc_id, unnest(list_concat(l[1:3], l[greatest(len(l) - 2, 1):len(l)])) AS raw FROM lines), keyed AS (SELECT doc_id, {NOISE_SQL.format('raw')} AS line FROM margin), sizes AS (SELECT doc_id, greatest(3, count(*) // 4) AS enough FROM pages_ GROUP BY 1), noise AS (SELECT doc_id, line FROM keyed JOIN sizes USING (doc_id) WHERE length(line) BETWEEN 4 AND 120 GROUP BY doc_id, line, enough HAVING count(*) >= enough)"
VALUES_SQL = "v AS (SELECT vec_id // 5 AS doc_id, vec_id % 5 AS position, 'l' || (vec_id % 13) AS value, embedding::DOUBLE[] AS e FROM embeddings), l AS (SELECT label, 'L' || label AS name, arg_min(embedding, vec_id)::DOUBLE[] AS e FROM embeddings GROUP BY 1)"
LIST_SQL = "SELECT d.doc_id, coalesce((SELECT string_agg(name, ',' ORDER BY p) FROM (SELECT name, p FROM h WHERE h.doc_id = d.doc_id ORDER BY p LIMIT 3)), 'Other') AS labels FROM (SELECT DISTINCT doc_id FROM v) d"

SQL = {
    "d2_margin_lines": f"WITH {PAGES_SQL}, {MARGIN_SQL} SELECT doc_id, line FROM noise",
    "d3_d4_clean_pages": f"WITH {PAGES_SQL}, {MARGIN_SQL}, k AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM pages_), b AS (SELECT doc_id, page, regexp_replace(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT EXISTS (SELECT 1 FROM noise n WHERE n.doc_id = k.doc_id AND n.line = {NOISE_SQL.format('k.x')})), ''), '^\\s+|\\s+$', '', 'g') AS body FROM k GROUP BY 1, 2), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, length(regexp_extract(body, '(?ims)\\A(.*?)^\\s*(references|bibliography|works cited)\\s*$', 1)) AS before, regexp_matches(body, '(?im)^\\s*(references|bibliography|works cited)\\s*$') AS has FROM b), f AS (SELECT *, min(page) FILTER (has AND page > n * 0.7) OVER (PARTITION BY doc_id) AS first FROM c) SELECT doc_id, page, CASE WHEN page > coalesce(first, 1000000) THEN 0 WHEN page = first THEN length(regexp_replace(left(body, before), '\\s+$', '')) ELSE length(body) END AS chars FROM f",
    "d12_d13_excerpts": "WITH t AS (SELECT doc_id, text, length(text) AS n, CASE WHEN length(text) <= 16000 THEN text ELSE left(text, 9000) || chr(10) || '[...]' || chr(10) || substring(text, greatest(9000, (length(text) - 5000) // 2) + 1, 5000) || chr(10) || '[...]' || chr(10) || right(text, 2000) END AS x, lower(left(text, 20000)) AS s FROM documents) SELECT doc_id, length(x) AS chars, md5(x) AS excerpt_md5, CASE WHEN trim(s, ' ') = '' THEN NULL WHEN regexp_matches(s, '[Ѐ-ӿ]') THEN 'Bulgarian' WHEN regexp_matches(s, 'transformaci|polit|digitalizaci') THEN 'Spanish' WHEN regexp_matches(s, 'strat|numer|gouvernance') THEN 'French' ELSE 'English' END AS language FROM t",
    "d14_metadata_json": "SELECT event_id AS doc_id, CASE WHEN event_id % 5 = 2 THEN 'file-' || event_id ELSE 'T' || event_id END AS title, CASE WHEN event_id % 5 <> 2 AND event_id % 3 <> 0 THEN (event_id % 50 + 1980)::INTEGER END AS year, CASE WHEN event_id % 5 <> 2 AND event_id % 4 <> 0 THEN '2024-02-03' END AS publication_date, CASE WHEN event_id % 5 = 2 THEN '' ELSE 'a,' || event_type END AS keywords FROM events",
    "f9_f16_strings": "SELECT event_id, 'Q ' || event_type || '|two \"x\" ' || user_id AS recovered, CASE event_id % 3 WHEN 0 THEN 'a|b, c' WHEN 1 THEN 'a|b|c' ELSE 'a|b;c' END AS listed, CASE WHEN length(k) <= 8 THEN '****' ELSE left(k, 4) || '…' || right(k, 4) END AS masked, event_id % 2 = 0 AS lossy FROM (SELECT *, 'key-' || repeat('x', (event_id % 7)::INTEGER) || user_id AS k FROM events)",
    "v5_j17_snapped_labels": f"WITH {VALUES_SQL}, n AS (SELECT v.doc_id, position, name, 1 - list_cosine_similarity(v.e, l.e) AS d FROM v, l QUALIFY row_number() OVER (PARTITION BY v.doc_id, position ORDER BY round(d, 9), label) = 1), s AS (SELECT doc_id, name, min(position) AS p FROM n WHERE d <= 0.6 GROUP BY 1, 2), x AS (SELECT v.doc_id, name, min(position) AS p FROM v JOIN l ON lower(value) = lower(name) WHERE v.doc_id NOT IN (SELECT doc_id FROM s) GROUP BY 1, 2), h AS (SELECT * FROM s UNION ALL SELECT * FROM x) {LIST_SQL}",
    "d15_taxonomy_labels": f"WITH {VALUES_SQL}, h AS (SELECT v.doc_id, name, min(position) AS p FROM v JOIN l ON lower(value) = lower(name) GROUP BY 1, 2) {LIST_SQL}",
    "v10_vector_literal": "SELECT vec_id, length(l) AS chars, md5(l) AS literal_md5 FROM (SELECT vec_id, '[' || array_to_string(list_transform(embedding::DOUBLE[], lambda x: format('{:.8f}', x)), ',') || ']' AS l FROM embeddings)",
    "d10_d11_embedding_input": f"WITH {LIBRARY_SQL.strip()} SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN left('About ' || original_filename || ' ' || repeat(source_type, 60), 240) || chr(10) || chr(10) ELSE '' END || text) AS input_md5, CASE WHEN doc_id % 3 = 0 AND length(trim(text, ' ')) >= 20 THEN 'detected' ELSE language END AS language FROM library",
    "s2_s4_content_checks": f"WITH {LIBRARY_SQL.strip()} SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN false WHEN 5 THEN false ELSE true END AS valid, CASE WHEN doc_id % 5 <> 0 THEN original_filename END AS filename, CASE WHEN doc_id % 5 = 0 THEN 'application/octet-stream' ELSE ['application/pdf', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'text/plain', 'text/markdown'][doc_id % 4 + 1] END AS mime_type FROM library",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "q6_thread_states": "WITH e AS (SELECT user_id AS thread, event_id AS seq, event_type AS kind, 'k' || (floor(value)::BIGINT % 11) AS key FROM events), s AS (SELECT thread, count(*) AS n, max(seq) AS last, count(*) FILTER (kind = 'purchase') AS turn, max(seq) FILTER (kind = 'purchase') AS begun FROM e GROUP BY 1), c AS (SELECT e.* FROM e JOIN s USING (thread) WHERE kind <> 'purchase' AND seq > coalesce(begun, -1)), t AS (SELECT thread, string_agg(key || '=' || calls, ',' ORDER BY key) AS tools FROM (SELECT thread, key, count(*) AS calls FROM c WHERE kind = 'click' AND key IS NOT NULL GROUP BY ALL) GROUP BY 1), f AS (SELECT thread, key, min(seq) AS seq FROM e WHERE kind = 'view' AND key IS NOT NULL GROUP BY thread, key), p AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY thread ORDER BY seq DESC) <= 4), g AS (SELECT thread, string_agg(key, ',' ORDER BY seq) AS pages FROM p GROUP BY 1) SELECT thread, n, last, turn, (SELECT count(*) FROM c WHERE c.thread = s.thread) AS since, coalesce(tools, '') AS tools, coalesce(pages, '') AS pages FROM s LEFT JOIN t USING (thread) LEFT JOIN g USING (thread)",
    "q6_folded_state": "WITH s AS (SELECT user_id, count(*) AS n, max(event_id) AS last, max(event_id) FILTER (event_type <> 'error') AS ok FROM events GROUP BY 1) SELECT s.user_id, n, (SELECT count(*) FROM events e WHERE e.user_id = s.user_id AND e.event_id > coalesce(ok, -1)) AS errors, last FROM s",
}
