"""Catalogue, dedup, governance and set queries over the library that the driver's tables stand for."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestack.functions import text as X
from lodestack.operators import catalogue as C
from lodestack.operators import dedup as D
from lodestack.operators import state as S
from lodestack.operators.stored import StoredTable
from lodestack.plans.library import CHUNKS_SQL, LIBRARY_SQL, chunks, library, table, visible
from lodestack.storage import shared_dir

NOW = "2024-03-01 00:00:00"
L = f"WITH {LIBRARY_SQL.strip()} "


def with_chunks(spark, sf_dir):
    docs = library(spark, sf_dir)
    return C.with_counts(docs, chunk_count=chunks(docs))


def visibility(spark, sf_dir):
    return library(spark, sf_dir).where(visible()).select("doc_id", F.coalesce("title", "original_filename").alias("display_title"), X.mime_type(F.col("original_filename")).alias("mime_type"))


def filtered(spark, sf_dir):
    return C.exact_filters(library(spark, sf_dir), policy_area="ASIA", source_type="report").select("doc_id", "country_region", "status")


def searched(spark, sf_dir):
    docs = C.search(library(spark, sf_dir), "asia")
    return docs.select("doc_id", F.array_join(C.match_fields("asia"), ",").alias("match_fields"))


def page_two(spark, sf_dir):
    out = C.page_of(with_chunks(spark, sf_dir).where(visible()), "chunks_desc", 2, 15)
    return out.select("doc_id", "chunk_count")


def orders(spark, sf_dir):
    docs = with_chunks(spark, sf_dir)
    out = None
    for name in C.ORDERS:
        first = C.page_of(docs, name, 1, 10).select(F.lit(name).alias("order_name"), "doc_id")
        out = first if out is None else out.unionByName(first)
    return out


def total_pages(spark, sf_dir):
    return C.totals(C.search(library(spark, sf_dir), "policy"), 20)


def chunk_counts(spark, sf_dir):
    return with_chunks(spark, sf_dir).select("doc_id", "page_count", "chunk_count")


def point_lookup(spark, sf_dir):
    docs = library(spark, sf_dir)
    asked = docs.where("doc_id % 100 = 0").select(F.explode(F.array(F.col("doc_id").cast("string"), F.col("original_filename"), F.concat(F.lit("missing-"), F.col("doc_id").cast("string")))).alias("identifier"))
    return C.lookup(asked, docs)


def resolve_ids(spark, sf_dir):
    docs = library(spark, sf_dir)
    return C.resolve(docs.select(F.col("original_filename").alias("identifier")), docs)


def chunk_scan(spark, sf_dir):
    docs = library(spark, sf_dir).where(visible())
    return chunks(docs).select("doc_id", "chunk_index", F.length("text").cast("long").alias("chars"), F.md5(F.substring("text", 1, 500)).alias("preview_md5"))


def pages_missing(spark, sf_dir):
    docs = library(spark, sf_dir)
    have = docs.where("status in ('parsed', 'annotated', 'ready')").select("doc_id")
    return docs.join(have, "doc_id", "left_anti").groupBy("status").agg(F.count("*").alias("n"), F.sum("page_count").alias("pages"))


def facets(spark, sf_dir):
    return C.facet_values(library(spark, sf_dir))


def dashboard(spark, sf_dir):
    docs = with_chunks(spark, sf_dir)
    return docs.agg(F.count_if(F.col("status") == "ready").alias("ready"), F.sum("chunk_count").alias("chunks"), F.count("*").alias("documents"))


def fingerprints(spark, sf_dir):
    return C.fingerprint(library(spark, sf_dir), "source_organisation", "uploaded_at")


def taxonomy_tree(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"), F.col("r_regionkey").alias("parent_order"), F.col("n_nationkey").alias("child_order"))
    return C.tree(rows).select("parent", "parent_order", F.array_join("children", ", ").alias("children"))


def uncategorised(spark, sf_dir):
    known = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_name").alias("country_region"))
    return library(spark, sf_dir).join(known, "country_region", "left_anti").groupBy("country_region").agg(F.count("*").alias("n"))


def sequential_uid(spark, sf_dir):
    return C.next_uid(table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.col("c_custkey").cast("string")).alias("uid")))


def any_vectors(spark, sf_dir):
    docs, vectors = library(spark, sf_dir), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return docs.join(vectors, "doc_id", "left_semi").groupBy("language").agg(F.count("*").alias("n"))


def exact_duplicates(spark, sf_dir):
    return D.groups(D.with_hashes(library(spark, sf_dir)), "sha256")


def normalised_duplicates(spark, sf_dir):
    return D.with_hashes(library(spark, sf_dir)).select("doc_id", "sha256", "content_hash")


def cleanup_report(spark, sf_dir):
    return D.keep_report(D.with_hashes(with_chunks(spark, sf_dir)), "content_hash", "chunk_count").select("doc_id", "keep_id", "action")


def windows(spark, sf_dir):
    return D.semantic_windows(table(spark, sf_dir, "documents")).select("doc_id", F.col("window").cast("int").alias("window"), F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


def semantic(spark, sf_dir):
    """Documents of three vectors each: doc vec_id // 3, window vec_id % 3; the copy of window w of document d is its own vector in document d + 1,000,000."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.floor(F.col("vec_id") / 3).alias("doc"), (F.col("vec_id") % 3).alias("window"))
    asked = rows.select(F.col("doc").alias("doc_id"), "window", "vector")
    held = rows.select(F.col("vec_id").alias("doc_id"), (F.col("doc") + F.when(F.col("doc") % 20 == 0, 1_000_000).otherwise(0)).alias("owner"), "vector")
    return D.semantic_duplicates(asked, held).select("doc_id", "duplicate_of", F.round("total_distance", 6).alias("total_distance"))


def page_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    raw = F.concat(F.lit(" "), F.upper(F.substring("url", 1, 8)), F.substring("url", 9, 10000), F.when(F.col("page_id") % 3 == 0, "#part").otherwise(""))
    return pages.select("page_id", "html", raw.alias("raw"), X.canonical_url(raw).alias("url"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("page_id") % 100).cast("int"))).alias("uploaded_at"))


def canonical_urls(spark, sf_dir):
    return page_urls(spark, sf_dir).select("page_id", "url")


def owned_urls(spark, sf_dir):
    docs = page_urls(spark, sf_dir).select(F.col("page_id").alias("doc_id"), F.regexp_replace("url", "[0-9]+", "N").alias("canonical_url"), "uploaded_at")
    out = S.unique_owner(docs, "canonical_url", [F.col("uploaded_at"), F.col("doc_id")])
    return out.where("canonical_url is not null").select("doc_id", "canonical_url")


def url_lookup(spark, sf_dir):
    docs = page_urls(spark, sf_dir).select(F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 2 == 0, F.col("url")).alias("canonical_url"), F.col("url").alias("source_url"), "uploaded_at")
    return D.url_owners(docs.select(F.col("source_url").alias("url")).distinct(), docs)


def import_layers(spark, sf_dir):
    docs = D.with_hashes(library(spark, sf_dir)).withColumn("url", F.concat(F.lit("https://example.com/"), F.when(F.col("doc_id") % 50 == 1, F.col("doc_id") - 1).otherwise(F.col("doc_id")).cast("string")))
    return D.import_decision(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"))


def import_checks(spark, sf_dir):
    pages = page_urls(spark, sf_dir)
    content = F.trim("html")
    size = F.octet_length(content)
    title = F.substring(F.coalesce(F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("Page "), F.col("page_id").cast("string"))), F.nullif(F.trim(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)), F.lit("")), F.col("url")), 1, 200)
    return pages.select("page_id", size.cast("long").alias("bytes"), ((size > 0) & (size <= 2 * 1024 * 1024)).alias("accepted"), title.alias("title"), X.slug_filename(title, F.col("url")).alias("filename"))


def governance_rows(spark, sf_dir):
    i, t = F.col("page_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = lambda days: t + F.make_dt_interval(days=days.cast("int"))
    return table(spark, sf_dir, "pages").where("page_id % 4 <> 3").select(i.alias("doc_id"), F.when(i % 5 == 0, "stale").when(i % 7 == 0, "archived").otherwise("active").alias("lifecycle_status"), F.when(i % 3 == 0, (i % 40 + 1).cast("int")).alias("refresh_interval_days"), at(i % 30).alias("last_fetched_at"), at(i % 90).alias("next_review_at"), F.when(i % 6 == 0, "timeout").alias("last_refresh_error"))


def governance_upsert(spark, sf_dir):
    imports = table(spark, sf_dir, "pages").where("page_id % 8 in (3, 4)").select(F.col("page_id").alias("doc_id"))
    return S.register_imports(governance_rows(spark, sf_dir), imports, NOW)


def governance_patch(spark, sf_dir):
    i = F.col("page_id")
    changes = table(spark, sf_dir, "pages").where("page_id % 2 = 0").select(i.alias("doc_id"), F.when(i % 10 == 0, "archived").alias("lifecycle_status"), F.when(i % 6 == 0, F.lit(7)).alias("refresh_interval_days"), F.when(i % 12 == 0, F.lit("2024-12-24 00:00:00").cast("timestamp_ntz")).alias("next_review_at"))
    return S.patch_governance(governance_rows(spark, sf_dir), changes, NOW)


def governance_due(spark, sf_dir):
    return S.due_for_review(governance_rows(spark, sf_dir), NOW, "active").select("doc_id", "next_review_at")


def metadata_rows(spark, sf_dir):
    docs = library(spark, sf_dir)
    none = F.array().cast("array<string>")
    old = docs.where("doc_id % 3 <> 2").select("doc_id", "title", "year", "keywords", F.array(F.lit("old")).alias("stakeholders"), F.when(F.col("doc_id") % 2 == 0, F.lit(NOW).cast("timestamp_ntz")).alias("reviewed_at"))
    new = docs.where("doc_id % 3 <> 1").select("doc_id", F.concat(F.lit("New "), F.col("original_filename")).alias("title"), F.lit(2024).alias("year"), F.when(F.col("doc_id") % 5 == 0, none).otherwise(F.array(F.lit("n"))).alias("keywords"), F.array(F.lit("new")).alias("stakeholders"))
    return old, new


def metadata_merge(spark, sf_dir):
    out = S.merge_generated(*metadata_rows(spark, sf_dir), "doc_id")
    return out.select("doc_id", "title", "year", F.array_join("keywords", ",").alias("keywords"), F.array_join("stakeholders", ",").alias("stakeholders"), F.col("reviewed_at").isNotNull().alias("reviewed"))


def metadata_patch(spark, sf_dir):
    old, new = metadata_rows(spark, sf_dir)
    out = S.patch(old, new.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("title")).alias("title"), "keywords"), "doc_id")
    return out.select("doc_id", "title", "year", F.array_join("keywords", ",").alias("keywords"))


def upserted(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = old.where("s_suppkey % 4 = 0").select("s_suppkey", F.upper("s_name").alias("s_name"), (F.col("s_acctbal") * 0).alias("s_acctbal"))
    kept = S.insert_missing(old.where("s_suppkey % 3 <> 0"), old.select("s_suppkey", F.lit("added").alias("s_name"), "s_acctbal"), ["s_suppkey"])
    return S.upsert(kept, new, ["s_suppkey"])


def cascaded(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    (left,) = S.cascade_delete(gone, "l_orderkey", table(spark, sf_dir, "lineitem"))
    return left.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def replaced(spark, sf_dir):
    old = chunks(table(spark, sf_dir, "documents"))
    new = old.where("doc_id % 4 = 0 and chunk_index = 0").select("doc_id", "chunk_index", F.reverse("text").alias("text"))
    return S.replace_children(old, new, "doc_id").select("doc_id", "chunk_index", F.md5("text").alias("text_md5"))


def invites(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    t = F.col("ts")
    rows = events.select("event_id", F.when(F.col("event_type") == "purchase", t).alias("consumed_at"), F.when(F.col("user_id") % 10 == 0, t).alias("revoked_at"), (t + F.make_dt_interval(days=F.lit(7))).alias("expires_at"))
    return rows.select("event_id", S.invite_state("2024-01-20 00:00:00").alias("state"))


def ordered_union(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return S.union_in_order(rows, ["user_id"], ["event_type"], "event_id")


def distinct_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.concat(F.lit(" "), F.col("p_type"))).alias("p_type"), "p_partkey")
    return C.distinct_in_order(rows, "p_brand", "p_type", "p_partkey")


def creators(spark, sf_dir):
    """Two aliases of one dimension: the customer's nation and the supplier's nation of an order line."""
    line, n = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    buyer = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("l_orderkey"), "c_nationkey")
    seller = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = line.join(buyer, "l_orderkey", "left").join(seller, "l_suppkey", "left")
    a, b = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("buyer")), n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("seller"))
    return rows.join(F.broadcast(a), "c_nationkey", "left").join(F.broadcast(b), "s_nationkey", "left").groupBy("buyer", "seller").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


def unregistered(spark, sf_dir):
    """Files that are not registered: even documents are known; the others count unless their bytes are known too."""
    docs = D.with_hashes(table(spark, sf_dir, "documents"))
    known = docs.where("doc_id % 2 = 0")
    new = docs.join(known.select("doc_id"), "doc_id", "left_anti").join(known.select("sha256").distinct(), "sha256", "left_anti")
    return new.select("doc_id", "sha256")


def stored_changes(spark, sf_dir):
    """The rows of a stored table of documents after an upsert of a tenth, some new ones and a deletion."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    stored = StoredTable(spark, f"{shared_dir(spark)}/lodestack-{spark.sparkContext.applicationId}/stored-{uuid.uuid4().hex}", docs.schema, ["doc_id"], 16)
    stored.replace(docs)
    stored.upsert(docs.where("doc_id % 10 = 0").select("doc_id", F.lit("new").alias("source"), (-F.col("n_chars")).alias("n_chars")))
    stored.insert_missing(docs.where("doc_id % 7 = 0").select((F.col("doc_id") * F.when(F.col("doc_id") % 2 == 0, 1).otherwise(-1)).alias("doc_id"), F.lit("added").alias("source"), "n_chars"))
    stored.delete(docs.where("doc_id % 13 = 1").select("doc_id"))
    return stored.rows()


QUERIES = {
    "u1_u10_stored_changes": stored_changes,
    "p1_p5_visibility": visibility, "p2_exact_filters": filtered, "p3_p4_search": searched, "t2_page": page_two, "t1_orders": orders, "a2_total_pages": total_pages,
    "catalogue_counts": chunk_counts, "s14_point_lookup": point_lookup, "s15_resolve": resolve_ids, "s16_s18_chunk_scan": chunk_scan, "s17_pages_missing": pages_missing,
    "a12_facets": facets, "a13_dashboard": dashboard, "a3_fingerprint": fingerprints, "a11_taxonomy_tree": taxonomy_tree, "j16_uncategorised": uncategorised, "a20_next_uid": sequential_uid,
    "j7_any_vectors": any_vectors, "x1_a4_exact_duplicates": exact_duplicates, "x2_normalised_hash": normalised_duplicates, "x6_w3_cleanup": cleanup_report, "x3_windows": windows, "x3_j13_semantic": semantic,
    "d19_canonical_url": canonical_urls, "w1_j9_url_owner": owned_urls, "x4_url_lookup": url_lookup, "x5_import_layers": import_layers, "d21_d22_import_checks": import_checks,
    "u5_governance_upsert": governance_upsert, "u6_governance_patch": governance_patch, "p13_q7_due": governance_due, "u3_metadata_merge": metadata_merge, "u4_metadata_patch": metadata_patch,
    "u1_u2_upsert": upserted, "u10_cascade": cascaded, "u7_replace": replaced, "p14_invites": invites, "u9_ordered_union": ordered_union, "a14_distinct_labels": distinct_labels, "j6_two_aliases": creators, "j15_unregistered": unregistered,
}

CHUNK_COUNT = f"{L}, {CHUNKS_SQL}, n AS (SELECT doc_id, count(*) AS chunk_count FROM chunks GROUP BY 1), docs AS (SELECT library.*, coalesce(chunk_count, 0) AS chunk_count FROM library LEFT JOIN n USING (doc_id)) "
FIELDS_SQL = "list_filter([CASE WHEN contains(lower(title), '{0}') THEN 'title' END, CASE WHEN contains(lower(original_filename), '{0}') THEN 'original_filename' END, CASE WHEN contains(lower(summary), '{0}') THEN 'summary' END, CASE WHEN contains(source_type, '{0}') THEN 'source_type' END, CASE WHEN contains(lower(source_organisation), '{0}') THEN 'source_organisation' END, CASE WHEN contains(lower(country_region), '{0}') THEN 'country_region' END, CASE WHEN contains(lower(array_to_string(policy_areas, ' ')), '{0}') THEN 'policy_areas' END, CASE WHEN contains(lower(array_to_string(keywords, ' ')), '{0}') THEN 'keywords' END, CASE WHEN contains(year::VARCHAR, '{0}') THEN 'year' END], lambda x: x IS NOT NULL)"
PAGES_SQL = "page_urls AS (SELECT page_id, html, url AS plain, regexp_replace(lower(left(url, 8)) || substring(url, 9), '#.*$', '') AS url, TIMESTAMP '2024-01-01' + to_hours((page_id % 100)::INTEGER) AS uploaded_at FROM pages)"
GOVERN_SQL = "g AS (SELECT page_id AS doc_id, CASE WHEN page_id % 5 = 0 THEN 'stale' WHEN page_id % 7 = 0 THEN 'archived' ELSE 'active' END AS lifecycle_status, CASE WHEN page_id % 3 = 0 THEN (page_id % 40 + 1)::INTEGER END AS refresh_interval_days, TIMESTAMP '2024-01-01' + to_days((page_id % 30)::INTEGER) AS last_fetched_at, TIMESTAMP '2024-01-01' + to_days((page_id % 90)::INTEGER) AS next_review_at, CASE WHEN page_id % 6 = 0 THEN 'timeout' END AS last_refresh_error FROM pages WHERE page_id % 4 <> 3)"
META_SQL = f"{L}, o AS (SELECT doc_id, title, year, keywords, ['old'] AS stakeholders, doc_id % 2 = 0 AS reviewed FROM library WHERE doc_id % 3 <> 2), n AS (SELECT doc_id, 'New ' || original_filename AS title, 2024 AS year, CASE WHEN doc_id % 5 = 0 THEN []::VARCHAR[] ELSE ['n'] END AS keywords, ['new'] AS stakeholders FROM library WHERE doc_id % 3 <> 1) "
HASH_SQL = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '))"

SQL = {
    "u1_u10_stored_changes": "WITH a AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE source END AS source, CASE WHEN doc_id % 10 = 0 THEN -n_chars ELSE n_chars END AS n_chars FROM documents), b AS (SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE -doc_id END AS doc_id, 'added' AS source, n_chars FROM documents WHERE doc_id % 7 = 0) SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 13 = 1)",
    "p1_p5_visibility": L + "SELECT doc_id, coalesce(title, original_filename) AS display_title, CASE WHEN original_filename LIKE '%.pdf' THEN 'application/pdf' WHEN original_filename LIKE '%.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN original_filename LIKE '%.txt' THEN 'text/plain' ELSE 'text/markdown' END AS mime_type FROM library WHERE approved AND access_level = 'public'",
    "p2_exact_filters": L + "SELECT doc_id, country_region, status FROM library WHERE approved AND access_level = 'public' AND list_contains(policy_areas, 'ASIA') AND source_type = 'report'",
    "p3_p4_search": L + f"SELECT doc_id, array_to_string(f, ',') AS match_fields FROM (SELECT doc_id, {FIELDS_SQL.format('asia')} AS f FROM library) WHERE len(f) > 0",
    "t2_page": CHUNK_COUNT + "SELECT doc_id, chunk_count FROM docs WHERE approved AND access_level = 'public' ORDER BY chunk_count DESC, doc_id LIMIT 15 OFFSET 15",
    "t1_orders": CHUNK_COUNT + "(SELECT 'uploaded_desc' AS order_name, doc_id FROM docs ORDER BY uploaded_at DESC, doc_id LIMIT 10) UNION ALL (SELECT 'name_asc', doc_id FROM docs ORDER BY lower(coalesce(title, original_filename)) NULLS LAST, doc_id LIMIT 10) UNION ALL (SELECT 'year_desc', doc_id FROM docs ORDER BY year DESC NULLS LAST, doc_id LIMIT 10) UNION ALL (SELECT 'chunks_desc', doc_id FROM docs ORDER BY chunk_count DESC, doc_id LIMIT 10)",
    "a2_total_pages": L + f"SELECT count(*) AS total, ceil(count(*) / 20.0)::BIGINT AS pages FROM library WHERE len({FIELDS_SQL.format('policy')}) > 0",
    "catalogue_counts": CHUNK_COUNT + "SELECT doc_id, page_count, chunk_count FROM docs",
    "s14_point_lookup": L + "SELECT i.identifier, d.doc_id FROM (SELECT unnest([doc_id::VARCHAR, original_filename, 'missing-' || doc_id]) AS identifier FROM library WHERE doc_id % 100 = 0) i LEFT JOIN library d ON i.identifier IN (d.doc_id::VARCHAR, d.original_filename)",
    "s15_resolve": L + "SELECT original_filename AS identifier, doc_id FROM library",
    "s16_s18_chunk_scan": f"{L}, {CHUNKS_SQL} SELECT c.doc_id, chunk_index, length(c.text) AS chars, md5(left(c.text, 500)) AS preview_md5 FROM chunks c JOIN library USING (doc_id) WHERE approved AND access_level = 'public'",
    "s17_pages_missing": L + "SELECT status, count(*) AS n, sum(page_count)::BIGINT AS pages FROM library WHERE status NOT IN ('parsed', 'annotated', 'ready') GROUP BY status",
    "a12_facets": L + "SELECT DISTINCT 'policy_area' AS facet, unnest(policy_areas) AS value FROM library UNION SELECT 'region', country_region FROM library UNION SELECT 'source_type', source_type FROM library",
    "a13_dashboard": CHUNK_COUNT + "SELECT count(*) FILTER (status = 'ready') AS ready, sum(chunk_count)::BIGINT AS chunks, count(*) AS documents FROM docs",
    "a3_fingerprint": L + "SELECT source_organisation, count(*) AS n, max(uploaded_at) AS changed FROM library GROUP BY 1",
    "a11_taxonomy_tree": "SELECT r_name AS parent, r_regionkey AS parent_order, string_agg(n_name, ', ' ORDER BY n_nationkey) AS children FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "j16_uncategorised": L + "SELECT country_region, count(*) AS n FROM library WHERE country_region NOT IN (SELECT n_name FROM nation WHERE n_nationkey < 20) GROUP BY 1",
    "a20_next_uid": "SELECT lpad((max(c_custkey) + 1)::VARCHAR, 5, '0') AS uid FROM customer WHERE c_custkey % 3 <> 0",
    "j7_any_vectors": L + "SELECT language, count(*) AS n FROM library WHERE doc_id IN (SELECT vec_id FROM embeddings) GROUP BY 1",
    "x1_a4_exact_duplicates": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "x2_normalised_hash": f"SELECT doc_id, sha256(text) AS sha256, sha256({HASH_SQL}) AS content_hash FROM documents",
    "x6_w3_cleanup": f"{CHUNK_COUNT}, h AS (SELECT doc_id, sha256({HASH_SQL}) AS k, chunk_count, uploaded_at FROM docs), r AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, first_value(doc_id) OVER (PARTITION BY k ORDER BY chunk_count DESC, uploaded_at, doc_id) AS keep_id FROM h) SELECT doc_id, keep_id, CASE WHEN doc_id = keep_id THEN 'keep' ELSE 'remove' END AS action FROM r WHERE n > 1",
    "x3_j13_semantic": "WITH v AS (SELECT vec_id, vec_id // 3 AS doc, vec_id % 3 AS w, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT a.vec_id AS q, a.doc AS doc_id, a.w, CASE WHEN b.doc % 20 = 0 THEN b.doc + 1000000 ELSE b.doc END AS owner, 1 - list_cosine_similarity(a.e, b.e) AS d, b.vec_id AS other FROM v a, v b), n AS (SELECT * FROM d WHERE d <= 0.05 QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(d, 9), other) <= 8), m AS (SELECT doc_id, w, owner, min(d) AS d FROM n WHERE owner <> doc_id GROUP BY ALL), c AS (SELECT doc AS doc_id, count(*) AS n_windows FROM v GROUP BY 1 HAVING count(*) >= 2), s AS (SELECT doc_id, owner, sum(d) AS total FROM m JOIN c USING (doc_id) GROUP BY doc_id, owner, n_windows HAVING count(*) = n_windows) SELECT doc_id, owner AS duplicate_of, round(total, 6) AS total_distance FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(total, 9), owner) = 1",
    "x3_windows": "WITH t AS (SELECT doc_id, trim(text, ' ') AS s FROM documents), w AS (SELECT doc_id, s, length(s) AS n, least(2000, greatest(600, length(s) // 4)) AS size FROM t WHERE length(s) >= 1200), p AS (SELECT doc_id, [substring(s, 1, size), substring(s, (n - size) // 2 + 1, size), substring(s, n - size + 1, size)] AS x FROM w), d AS (SELECT doc_id, list_filter(x, lambda v, i: list_position(x, v) = i) AS x FROM p), e AS (SELECT doc_id, unnest(range(0, len(x))) AS k, x FROM d) SELECT doc_id, k::INTEGER AS window, length(x[k + 1]) AS chars, md5(x[k + 1]) AS text_md5 FROM e",
    "d19_canonical_url": f"WITH {PAGES_SQL} SELECT page_id, url FROM page_urls",
    "w1_j9_url_owner": f"WITH {PAGES_SQL} SELECT page_id AS doc_id, regexp_replace(url, '[0-9]+', 'N', 'g') AS canonical_url FROM page_urls QUALIFY row_number() OVER (PARTITION BY regexp_replace(url, '[0-9]+', 'N', 'g') ORDER BY uploaded_at, page_id) = 1",
    "x4_url_lookup": f"WITH {PAGES_SQL} SELECT url, page_id AS doc_id FROM page_urls QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id % 2, uploaded_at, page_id) = 1",
    "x5_import_layers": f"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 50 = 1 THEN doc_id - 1 ELSE doc_id END AS u, sha256(text) AS a, sha256({HASH_SQL}) AS b FROM documents), k AS (SELECT * FROM d WHERE doc_id % 2 = 0), r AS (SELECT doc_id, (SELECT min(k.doc_id) FROM k WHERE k.u = d.u) AS x, (SELECT min(k.doc_id) FROM k WHERE k.a = d.a) AS y, (SELECT min(k.doc_id) FROM k WHERE k.b = d.b) AS z FROM d WHERE doc_id % 2 = 1) SELECT doc_id, coalesce(x, y, z) AS existing_id, CASE WHEN x IS NOT NULL THEN 'url' WHEN y IS NOT NULL THEN 'bytes' WHEN z IS NOT NULL THEN 'text' ELSE 'new' END AS layer FROM r",
    "d21_d22_import_checks": f"WITH {PAGES_SQL}, t AS (SELECT page_id, url, strlen(trim(html, ' ')) AS bytes, left(coalesce(CASE WHEN page_id % 4 = 0 THEN 'Page ' || page_id END, nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), ' '), ''), url), 200) AS title FROM page_urls), s AS (SELECT *, left(replace(trim(regexp_replace(title, '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\- ]+', '', 'g'), ' '), ' ', '_'), 80) AS base FROM t) SELECT page_id, bytes, bytes BETWEEN 1 AND 2097152 AS accepted, title, CASE WHEN base <> '' THEN base ELSE left(sha256(url), 16) END || '.md' AS filename FROM s",
    "u5_governance_upsert": f"WITH {GOVERN_SQL}, i AS (SELECT page_id AS doc_id FROM pages WHERE page_id % 8 IN (3, 4)) SELECT coalesce(g.doc_id, i.doc_id) AS doc_id, coalesce(lifecycle_status, 'active') AS lifecycle_status, coalesce(refresh_interval_days, 30)::INTEGER AS refresh_interval_days, CASE WHEN i.doc_id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE last_fetched_at END AS last_fetched_at, CASE WHEN i.doc_id IS NOT NULL THEN TIMESTAMP '{NOW}' + to_days(coalesce(refresh_interval_days, 30)::INTEGER) ELSE next_review_at END AS next_review_at, CASE WHEN i.doc_id IS NULL THEN last_refresh_error END AS last_refresh_error FROM g FULL JOIN i ON g.doc_id = i.doc_id",
    "u6_governance_patch": f"WITH {GOVERN_SQL}, c AS (SELECT page_id AS doc_id, CASE WHEN page_id % 10 = 0 THEN 'archived' END AS s, CASE WHEN page_id % 6 = 0 THEN 7 END AS d, CASE WHEN page_id % 12 = 0 THEN TIMESTAMP '2024-12-24' END AS n FROM pages WHERE page_id % 2 = 0) SELECT g.doc_id, coalesce(s, lifecycle_status) AS lifecycle_status, coalesce(d, refresh_interval_days)::INTEGER AS refresh_interval_days, last_fetched_at, coalesce(n, TIMESTAMP '{NOW}' + to_days(d::INTEGER), next_review_at) AS next_review_at, last_refresh_error, CASE WHEN s = 'archived' THEN false END AS approved_override FROM g LEFT JOIN c ON g.doc_id = c.doc_id",
    "p13_q7_due": f"WITH {GOVERN_SQL} SELECT doc_id, next_review_at FROM g WHERE next_review_at <= TIMESTAMP '{NOW}' AND lifecycle_status = 'active'",
    "u3_metadata_merge": META_SQL + "SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL OR (o.reviewed AND o.title IS NOT NULL) THEN o.title ELSE n.title END AS title, CASE WHEN n.doc_id IS NULL OR (o.reviewed AND o.year IS NOT NULL) THEN o.year ELSE n.year END::INTEGER AS year, array_to_string(CASE WHEN n.doc_id IS NULL OR (o.reviewed AND len(o.keywords) > 0) THEN o.keywords ELSE n.keywords END, ',') AS keywords, CASE WHEN n.doc_id IS NULL THEN 'old' ELSE 'new' END AS stakeholders, coalesce(o.reviewed, false) AS reviewed FROM o FULL JOIN n ON o.doc_id = n.doc_id",
    "u4_metadata_patch": META_SQL + "SELECT o.doc_id, CASE WHEN n.doc_id % 2 = 0 THEN n.title ELSE o.title END AS title, o.year, array_to_string(CASE WHEN len(n.keywords) > 0 THEN n.keywords ELSE o.keywords END, ',') AS keywords FROM o LEFT JOIN n ON o.doc_id = n.doc_id",
    "u1_u2_upsert": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN upper(s_name) WHEN s_suppkey % 3 = 0 THEN 'added' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal * 0 ELSE s_acctbal END AS s_acctbal FROM supplier",
    "u10_cascade": "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "u7_replace": f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, md5(CASE WHEN doc_id % 4 = 0 THEN reverse(text) ELSE text END) AS text_md5 FROM chunks WHERE doc_id % 4 <> 0 OR chunk_index = 0",
    "p14_invites": "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'used' WHEN user_id % 10 = 0 THEN 'revoked' WHEN ts + INTERVAL 7 DAY <= TIMESTAMP '2024-01-20' THEN 'expired' ELSE 'active' END AS state FROM events",
    "u9_ordered_union": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2",
    "a14_distinct_labels": "SELECT p_brand, arg_min(CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE p_type END, p_partkey) AS p_type, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand, lower(p_type)",
    "j6_two_aliases": "SELECT b.n_name AS buyer, s.n_name AS seller, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation b ON c_nationkey = b.n_nationkey LEFT JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY 1, 2",
    "j15_unregistered": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)",
}
