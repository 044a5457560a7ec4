"""Filter, conversation and evaluation queries.

Conversations are chat sessions, turn is the order of messages. Events are tool calls and clicks: user_id is the session, event_type the tool. Questions
with constraints are benchmark items behind one of eight phrases.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import text as X
from lodestack.operators import catalogue as C
from lodestack.operators import chat as H
from lodestack.operators import dedup as D
from lodestack.operators import evaluation as E
from lodestack.operators import filters as M
from lodestack.operators import facets, knn
from lodestack.plans.library import LIBRARY_SQL, library, table
from lodestack.storage import keep

PHRASES = (
    "Use ASIA documents published before 2016.",
    "Files from NATION_5 and NATION_6 after 2010, documents in English.",
    "Only sources since 2005 until 2012; tag: en",
    "The latest policy of EUROPE in 2001 or 2003?",
    "Compare NATION_9 and NATION_8, spanish-language sources, tag: src1",
    "What was prior to 1999 and after 2020?",
    "filter the files which came before 2008, especially after 2009",
    "A question without constraints",
)


def questions(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("item_id") % 8).cast("int") + 1)
    return items.select(F.col("item_id").alias("query_id"), F.concat(phrase, F.lit(" #"), F.col("item_id").cast("string")).alias("question"))


def labels(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return region.select(F.lit("policy_areas").alias("dimension"), F.col("r_name").alias("value")).unionByName(nation.select(F.lit("country_regions").alias("dimension"), F.col("n_name").alias("value")))


def inferred(spark, sf_dir):
    return M.infer(questions(spark, sf_dir), labels(spark, sf_dir), 2024)


def filter_inference(spark, sf_dir):
    shown = [F.array_join(d, ",").alias(d) for d in facets.DIMENSIONS]
    return inferred(spark, sf_dir).select("query_id", *shown, "year_from", "year_to", "freshness")


def filter_application(spark, sf_dir):
    return M.match_counts(inferred(spark, sf_dir), library(spark, sf_dir))


def given_filters(spark, sf_dir):
    """Filters of questions beside which something was chosen, and how many documents they leave; sources are labels too."""
    items = table(spark, sf_dir, "benchmark")
    i = F.col("item_id") % 5
    given = items.select(
        F.col("item_id").alias("query_id"), F.when(i == 1, F.lit("asia ")).alias("policy_area"), F.when(i == 2, F.lit("nation_5")).alias("country_or_region"),
        F.when(i == 3, F.concat(F.lit("SRC"), (F.col("item_id") % 20).cast("string"))).alias("source_organisation"), F.when(i == 4, F.lit("EN")).alias("language"),
        F.when(i == 4, F.array(F.lit("en"), F.lit(" EN"), F.lit(" "))).alias("tags"), F.when(i == 2, F.lit(2000)).alias("published_year_from"), F.when(i == 4, F.lit(2010)).alias("published_year_to"),
    )
    docs = library(spark, sf_dir)
    sources = docs.select(F.lit("source_organisations").alias("dimension"), F.col("source_organisation").alias("value")).where("value is not null").distinct()
    found = keep(M.infer(questions(spark, sf_dir), labels(spark, sf_dir).unionByName(sources), 2024, given), "given-filters")
    counts = M.match_counts(found, docs)
    shown = [F.array_join(d, ",").alias(d) for d in facets.DIMENSIONS]
    return found.join(counts, "query_id").select("query_id", *shown, "year_from", "year_to", "freshness", "n_matched", "fallback")


def region_coverage(spark, sf_dir):
    """Regions that a question names, with the documents of the same number modulo 40 as what is cited."""
    asked = inferred(spark, sf_dir).select("query_id", F.explode("country_regions").alias("region"))
    docs = library(spark, sf_dir)
    cited = docs.select((F.col("doc_id") % 40).alias("query_id"), "doc_id", "text")
    return M.missing_regions(asked, cited, docs)


def region_supplement(spark, sf_dir):
    docs = library(spark, sf_dir)
    kept = docs.where("doc_id % 5 = 0").select((F.col("doc_id") % 40).alias("query_id"), "doc_id", F.col("doc_id").alias("position"))
    extra = docs.select((F.col("doc_id") % 40).alias("query_id"), F.col("country_region").alias("region"), "doc_id", F.col("doc_id").alias("rank"))
    return M.supplement(kept, extra)


def messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def turns(spark, sf_dir):
    return H.turn_index(messages(spark, sf_dir)).select("session_id", "seq", F.col("turn").cast("int").alias("turn"))


def current_turn(spark, sf_dir):
    return H.current_turn(messages(spark, sf_dir)).select("session_id", "seq", "role")


def history(spark, sf_dir):
    return H.history(messages(spark, sf_dir), 4).select("session_id", "seq", F.col("position").cast("int").alias("position"))


def session_list(spark, sf_dir):
    return H.sessions(messages(spark, sf_dir))


def usage(spark, sf_dir):
    m = messages(spark, sf_dir)
    reports = F.col("session_id") % 3 != 0
    return H.token_usage(m.select("session_id", "seq", "role", F.when(reports, F.length("content")).alias("input_tokens"), F.when(reports & (F.col("seq") % 2 == 0), F.col("seq")).alias("output_tokens")))


def calls(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.dayofmonth("ts").alias("turn"), F.col("event_type").alias("tool"), "event_id")


def budgets(spark, sf_dir):
    return H.tool_budget(calls(spark, sf_dir).select("session_id", "turn", "tool"), {"click": 2, "view": 3, "purchase": 1})


def tool_choice(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    counts = F.create_map(F.lit("search_internal"), (i % 3).cast("int"), F.lit("search_web"), (i % 2).cast("int"))
    tools = H.tools_for(i % 4 == 0, F.when(i % 5 == 0, "direct").otherwise("chat"), counts, {"search_internal": 2, "search_corpus": 2, "search_web": 1, "manage_library": 1})
    ordered = H.tier_order(tools, i % 3 > 0, i % 7 > 2, F.col("event_type") == "error")
    return e.select("event_id", F.array_join(ordered, ",").alias("tools"), H.route(F.col("value") > 50, F.when(i % 5 == 0, "direct").otherwise("chat"), F.when(i % 6 == 0, "policymaker").otherwise("general")).alias("route"))


def newest_clicks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", "event_id", "ts")
    return C.top_per_group(rows, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 5).select("user_id", "event_id", F.col("rank").cast("int").alias("rank"))


def citations(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("position"), F.concat("event_type", F.lit("/"), (F.col("event_id") % 4).cast("string")).alias("key"))
    return H.numbered_citations(e).select("session_id", "position", "key", F.col("number").cast("int").alias("number"))


def page_log(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("position"), F.get_json_object("props", "$.k").alias("url"))
    return H.pages_seen(e, 20)


def seen_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select((F.col("page_id") % 10).alias("session_id"), (F.floor(F.col("page_id") / 10) % 3).alias("turn"), F.col("page_id").alias("position"), "url", F.concat(F.lit("Title "), (F.col("page_id") % 60).cast("string")).alias("title"))


def references(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ask_id"), (F.col("item_id") % 10).alias("session_id"), F.when(F.col("item_id") % 2 == 0, (F.col("item_id") % 3)).alias("turn_hint"), F.element_at(F.array(*[F.lit(x) for x in ("first", "second", "third", "last", "Title 1", "title", "Title 12", "nothing")]), (F.floor(F.col("item_id") / 4) % 8).cast("int") + 1).alias("hint"))
    return H.resolve_reference(seen_pages(spark, sf_dir), asked)


def traces(spark, sf_dir):
    p = seen_pages(spark, sf_dir).select(F.concat_ws("-", F.col("session_id").cast("string"), F.col("turn").cast("string")).alias("call_id"), "position", "title")
    return H.trace_summary(p)


def notices(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("fallback"), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("notice"), (F.col("event_type") == "purchase").alias("satisfied"))
    return H.filter_notice(e).select("session_id", "seq", "standing")


def grounds(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = F.concat("event_type", F.lit(":"), (F.col("event_id") % 9).cast("string"))
    seen = e.where("event_id % 2 = 0").select(F.col("user_id").alias("session_id"), key.alias("key"))
    return H.new_ground(seen, e.where("event_id % 2 = 1").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("session_id"), key.alias("key")))


def evidence_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = docs.select(F.col("doc_id").alias("number"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("chunk_id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("u"), (F.col("doc_id") % 100).cast("string"))).alias("url"), F.substring("text", 1, 500).alias("quote"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "text")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("url"), F.col("html").alias("text"))
    return H.evidence_texts(n, chunks, pages).select("number", F.md5("text").alias("text_md5"))


def final_messages(spark, sf_dir):
    m = messages(spark, sf_dir).select((F.col("session_id") * 1000 + F.col("seq")).alias("message_id"), "content", F.lit("streaming").alias("status"))
    done = m.where("message_id % 3 <> 0").select("message_id", F.when(F.col("message_id") % 2 == 0, F.concat(F.lit("new "), F.col("message_id").cast("string"))).otherwise(F.lit("")).alias("new_content"), (F.col("message_id") % 5 == 0).alias("failed"))
    out = H.finalised(m, done)
    return out.select("message_id", F.md5("content").alias("content_md5"), "status")


def cited(spark, sf_dir):
    from lodestack.operators.evidence import cited_tiers

    answers = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), F.concat(F.lit("See ["), (F.col("item_id") % 4).cast("string"), F.lit("], ["), (F.col("item_id") % 3).cast("string"), F.lit("] and [9].")).alias("answer"))
    cites = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), F.explode(F.array(*[F.struct(F.lit(n).alias("number"), F.lit(t).alias("tier"), F.lit(d).alias("doc_id")) for n, t, d in ((0, "web", 9), (1, "internal", 1), (2, "full_corpus", 1), (3, "full_corpus", 2))])).alias("c")).select("answer_id", "c.*")
    return cited_tiers(answers, cites)


def web_intents(spark, sf_dir):
    i = F.col("query_id")
    q = F.concat("question", F.when(i % 4 == 0, " Please SEARCH the web").when(i % 4 == 1, " no web search").when(i % 4 == 2, " verify online").otherwise(" verify this"))
    return questions(spark, sf_dir).select("query_id", H.requires_web_check(q).alias("requires_check"), H.requests_web_search(q).alias("requests_search"))


def fallback_actions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    last = F.element_at(F.array(*[F.lit(x) for x in (None, "search_internal_documents", "search_full_corpus", "search_web", "ask_user")]), (i % 5).cast("int") + 1)
    allowed = F.array_compact(F.array(F.when(i % 2 == 0, "search_full_corpus"), F.when(i % 3 == 0, "search_web"), F.when(i % 7 > 0, "prepare_final_answer"), F.lit("search_internal_documents")))
    return e.select("event_id", H.fallback_action(last, F.col("value") > 50, F.col("event_type") == "click", allowed).alias("action"))


def started(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("session_id"), F.concat(F.lit("And "), F.col("conv_id").cast("string"), F.lit("?")).alias("question")).unionByName(spark.createDataFrame([(-1, "nobody")], "session_id long, question string"))
    out = H.started_turns(messages(spark, sf_dir), asked, 3)
    return out.select("session_id", "seq", "role", "content", "status", F.size(F.from_json("history", "array<struct<role:string,content:string>>")).cast("long").alias("n_history"))


def transcripts(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("citations_json", F.when(F.col("seq") % 3 == 0, F.concat(F.lit('[{"number": '), F.col("seq").cast("string"), F.lit("}]"))).when(F.col("seq") % 3 == 1, "broken ["))
    out = H.transcript(m, "citations_json", "array<struct<number:int>>")
    return out.select("session_id", "seq", F.size("citations_json").cast("long").alias("n_citations"), F.get("citations_json", F.lit(0))["number"].alias("first_number"))


def status_views(spark, sf_dir):
    return library(spark, sf_dir).select(H.status_view(F.col("status")).alias("v")).groupBy("v.shown", "v.progress").agg(F.count("*").alias("n"))


def suggestions(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group_id"), F.col("turn").alias("position"), "role", "text")
    history = m.where("role = 'user' and position % 4 = 1")
    originals = m.where("position = 0")
    return D.clean_candidates(m.select("group_id", "position", "text"), history, originals, 60, 3).select("group_id", F.col("kept").cast("int").alias("kept"), F.md5("text").alias("text_md5"))


def eval_ranks(spark, sf_dir):
    """Vectors with id divisible by 100 as cases; another vector of the same label is relevant."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    q = rows.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vector", F.col("label").alias("q_label"))
    found = knn.nearest(q, rows.where("doc_id % 100 <> 0"), 10).join(rows.select("doc_id", "label"), "doc_id").join(q.select("query_id", "q_label"), "query_id")
    return found.select(F.col("query_id").alias("case_id"), "doc_id", "distance", "rank", (F.col("label") == F.col("q_label")).alias("relevant"))


def recall(spark, sf_dir):
    return E.recall_and_mrr(eval_ranks(spark, sf_dir))


def acceptance(spark, sf_dir):
    best = eval_ranks(spark, sf_dir).groupBy("case_id").agg(F.coalesce(F.max(F.when(F.col("relevant"), 1 - F.col("distance"))), F.lit(0.0)).alias("relevant_similarity"), F.coalesce(F.max(F.when(~F.col("relevant"), 1 - F.col("distance"))), F.lit(0.0)).alias("distractor_similarity"))
    out = E.embedding_acceptance(best)
    return out.select(*[F.round(c, 6).alias(c) for c in ("top1", "margin", "relevant", "distractor")], "accepted")


def threshold(spark, sf_dir):
    cases = eval_ranks(spark, sf_dir).select(F.col("distance").alias("value"), F.col("relevant").alias("expected"))
    out = E.calibration(cases, 0.6)
    return out.select("cases", *[F.round(c, 6).alias(c) for c in out.columns if c != "cases"])


def two_stage(spark, sf_dir):
    ranks = eval_ranks(spark, sf_dir)
    again = E.ranked(ranks.where("rank <= 3").withColumn("s", F.col("doc_id") % 7 - F.col("distance")), "s", "doc_id")
    out = E.two_stage(ranks, again)
    return out.select(F.round("recall", 6).alias("recall"), F.round("top1", 6).alias("top1"), "accepted")


QUERIES = {
    "f3_f7_filter_inference": filter_inference, "p8_p11_filter_application": filter_application, "f3_p8_given_filters": given_filters, "e10_missing_regions": region_coverage, "e9_region_supplement": region_supplement,
    "w6_turn_index": turns, "w10_current_turn": current_turn, "w7_history": history, "j5_c3_sessions": session_list, "a9_token_usage": usage, "a10_tool_budget": budgets, "c5_c8_tools_and_route": tool_choice,
    "t8_newest_clicks": newest_clicks, "w8_citation_numbers": citations, "t9_page_log": page_log, "w5_c11_references": references, "c9_trace_summary": traces, "c10_filter_notice": notices, "e14_new_ground": grounds,
    "e15_evidence_texts": evidence_texts, "c2_final_messages": final_messages, "e13_cited_tiers": cited, "f18_web_intent": web_intents, "c7_fallback_action": fallback_actions, "c1_started_turns": started, "c4_transcript": transcripts, "d18_status_view": status_views, "x7_suggestions": suggestions,
    "a16_recall": recall, "a17_acceptance": acceptance, "a18_calibration": threshold, "a19_two_stage": two_stage,
}

PHRASE_SQL = "questions AS (SELECT item_id AS query_id, [" + ", ".join("'" + p + "'" for p in PHRASES) + "][item_id % 8 + 1] || ' #' || item_id AS question FROM benchmark)"
# What the phrases ask for, by number, as a reader would fill it in.
EXPECT_SQL = """expected AS (SELECT query_id, query_id % 8 AS k,
  CASE query_id % 8 WHEN 0 THEN ['ASIA'] WHEN 3 THEN ['EUROPE'] ELSE [] END::VARCHAR[] AS policy_areas,
  CASE query_id % 8 WHEN 1 THEN ['NATION_5', 'NATION_6'] WHEN 4 THEN ['NATION_8', 'NATION_9'] ELSE [] END::VARCHAR[] AS country_regions,
  []::VARCHAR[] AS source_organisations,
  CASE query_id % 8 WHEN 1 THEN ['English'] WHEN 4 THEN ['Spanish'] ELSE [] END::VARCHAR[] AS languages,
  CASE query_id % 8 WHEN 2 THEN ['en'] WHEN 4 THEN ['src1'] ELSE [] END::VARCHAR[] AS tags,
  CASE query_id % 8 WHEN 1 THEN 2011 WHEN 2 THEN 2005 WHEN 3 THEN 2001 WHEN 5 THEN 1999 END::INTEGER AS year_from,
  CASE query_id % 8 WHEN 0 THEN 2015 WHEN 2 THEN 2012 WHEN 3 THEN 2003 WHEN 5 THEN 2020 WHEN 6 THEN 2007 END::INTEGER AS year_to,
  query_id % 8 = 3 AS freshness FROM questions)"""
MATCH_SQL = """(len(f.policy_areas) = 0 OR list_has_any(f.policy_areas, d.policy_areas)) AND (len(f.country_regions) = 0 OR list_contains(f.country_regions, d.country_region))
  AND (len(f.languages) = 0 OR list_contains(list_transform(f.languages, lambda x: lower(x)), lower(d.language))) AND list_has_all(d.keywords, f.tags)
  AND (f.year_from IS NULL OR coalesce(d.year >= f.year_from, false)) AND (f.year_to IS NULL OR coalesce(d.year <= f.year_to, false))"""
KNN_SQL = """ev AS (SELECT q.vec_id AS case_id, e.vec_id AS doc_id, 1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance, q.label = e.label AS relevant,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9), e.vec_id) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND e.vec_id % 100 <> 0 QUALIFY rank <= 10)"""
M_SQL = "m AS (SELECT conv_id AS session_id, turn AS seq, role, text AS content FROM conversations)"
SEEN_SQL = "seen AS (SELECT page_id % 10 AS session_id, (page_id // 10) % 3 AS turn, page_id AS position, url, 'Title ' || (page_id % 60) AS title FROM pages)"

# What is chosen beside a question stands first, and what the question names behind it, unless it is the same.
GIVEN_SQL = """filters AS (SELECT query_id,
  CASE WHEN g = 1 THEN list_prepend('asia', list_filter(policy_areas, lambda x: lower(x) <> 'asia')) ELSE policy_areas END AS policy_areas,
  CASE WHEN g = 2 THEN list_prepend('nation_5', list_filter(country_regions, lambda x: lower(x) <> 'nation_5')) ELSE country_regions END AS country_regions,
  CASE WHEN g = 3 THEN list_prepend('SRC' || (query_id % 20), list_filter(named, lambda x: lower(x) <> 'src' || (query_id % 20))) ELSE named END AS source_organisations,
  CASE WHEN g = 4 THEN list_prepend('EN', languages) ELSE languages END AS languages, CASE WHEN g = 4 THEN list_prepend('en', list_filter(tags, lambda x: lower(x) <> 'en')) ELSE tags END AS tags,
  CASE WHEN g = 2 THEN 2000 WHEN g = 4 THEN CASE WHEN freshness THEN 2019 END ELSE year_from END AS year_from, CASE WHEN g = 2 THEN NULL WHEN g = 4 THEN 2010 ELSE year_to END AS year_to, freshness
  FROM (SELECT *, query_id % 5 AS g, CASE WHEN k = 4 THEN ['src1'] ELSE [] END::VARCHAR[] AS named FROM expected))"""

SQL = {
    "f3_p8_given_filters": f"WITH {PHRASE_SQL}, {EXPECT_SQL}, {GIVEN_SQL}, {LIBRARY_SQL.strip()}, low AS (SELECT query_id, list_transform(policy_areas, lambda x: lower(x)) AS a, list_transform(country_regions, lambda x: lower(x)) AS c, list_transform(source_organisations, lambda x: lower(x)) AS o, list_transform(languages, lambda x: lower(x)) AS l, list_transform(tags, lambda x: lower(x)) AS t, year_from, year_to FROM filters), n AS (SELECT f.query_id, count(*) AS n FROM low f JOIN library d ON len(a) + len(c) + len(o) + len(l) + len(t) + coalesce(year_from, 0) + coalesce(year_to, 0) > 0 AND (len(a) = 0 OR list_has_any(a, list_transform(d.policy_areas, lambda x: lower(x)))) AND (len(c) = 0 OR list_contains(c, lower(d.country_region))) AND (len(o) = 0 OR list_contains(o, lower(d.source_organisation))) AND (len(l) = 0 OR list_contains(l, lower(d.language))) AND list_has_all(list_transform(d.keywords, lambda x: lower(x)), t) AND (f.year_from IS NULL OR coalesce(d.year >= f.year_from, false)) AND (f.year_to IS NULL OR coalesce(d.year <= f.year_to, false)) GROUP BY 1) SELECT query_id, array_to_string(policy_areas, ',') AS policy_areas, array_to_string(country_regions, ',') AS country_regions, array_to_string(source_organisations, ',') AS source_organisations, array_to_string(languages, ',') AS languages, array_to_string(tags, ',') AS tags, year_from, year_to, freshness, coalesce(n, CASE WHEN len(policy_areas) + len(country_regions) + len(source_organisations) + len(languages) + len(tags) + coalesce(year_from, 0) + coalesce(year_to, 0) = 0 THEN (SELECT count(*) FROM library) ELSE 0 END) AS n_matched, n IS NULL AND len(policy_areas) + len(country_regions) + len(source_organisations) + len(languages) + len(tags) + coalesce(year_from, 0) + coalesce(year_to, 0) > 0 AS fallback FROM filters LEFT JOIN n USING (query_id)",
    "f3_f7_filter_inference": f"WITH {PHRASE_SQL}, {EXPECT_SQL} SELECT query_id, array_to_string(policy_areas, ',') AS policy_areas, array_to_string(country_regions, ',') AS country_regions, '' AS source_organisations, array_to_string(languages, ',') AS languages, array_to_string(tags, ',') AS tags, year_from, year_to, freshness FROM expected",
    "p8_p11_filter_application": f"WITH {PHRASE_SQL}, {EXPECT_SQL}, {LIBRARY_SQL.strip()}, n AS (SELECT f.query_id, count(*) AS n FROM expected f JOIN library d ON {MATCH_SQL} GROUP BY 1), r AS (SELECT f.*, coalesce(n, 0) AS n_matched, k <> 7 AS applied, concat_ws('; ', CASE WHEN len(policy_areas) > 0 THEN 'policy area=' || array_to_string(policy_areas, ', ') END, CASE WHEN len(country_regions) > 0 THEN 'region=' || array_to_string(country_regions, ', ') END, CASE WHEN len(languages) > 0 THEN 'language=' || array_to_string(languages, ', ') END, CASE WHEN len(tags) > 0 THEN 'tag=' || array_to_string(tags, ', ') END, CASE WHEN year_from = year_to THEN 'year=' || year_from END, CASE WHEN year_from IS DISTINCT FROM year_to THEN 'year>=' || year_from END, CASE WHEN year_from IS DISTINCT FROM year_to THEN 'year<=' || year_to END) AS d FROM expected f LEFT JOIN n USING (query_id)), s AS (SELECT *, CASE WHEN d = '' THEN 'none' ELSE d END AS description FROM r) SELECT query_id, applied, applied AND n_matched = 0 AS fallback, n_matched, description, CASE WHEN NOT applied THEN NULL WHEN n_matched > 0 THEN 'Applied document metadata filters: ' || description || '.' WHEN freshness THEN 'No documents matched the requested current/recent filter (' || description || '). The search was expanded to the original document scope; older sources may no longer reflect current policy.' ELSE 'No documents matched the requested metadata filters (' || description || '). The search was expanded to the original document scope, so the returned sources may not satisfy every requested constraint.' END AS notice FROM s",
    "e10_missing_regions": f"WITH {PHRASE_SQL}, {EXPECT_SQL}, {LIBRARY_SQL.strip()}, a AS (SELECT query_id, unnest(country_regions) AS region FROM expected), c AS (SELECT doc_id % 40 AS query_id, country_region, text FROM library) SELECT query_id, region FROM a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.query_id = a.query_id AND (c.country_region = a.region OR contains(lower(c.text), lower(a.region))))",
    "e9_region_supplement": f"WITH {LIBRARY_SQL.strip()}, k AS (SELECT doc_id % 40 AS query_id, doc_id, doc_id AS position FROM library WHERE doc_id % 5 = 0), x AS (SELECT doc_id % 40 AS query_id, country_region AS region, doc_id FROM library WHERE doc_id % 5 <> 0) SELECT * FROM k UNION ALL SELECT x.query_id, x.doc_id, coalesce((SELECT max(position) FROM k WHERE k.query_id = x.query_id), 0) + row_number() OVER (PARTITION BY x.query_id ORDER BY region, x.doc_id) FROM x",
    "w6_turn_index": f"WITH {M_SQL} SELECT session_id, seq, (count(*) FILTER (role = 'user') OVER (PARTITION BY session_id ORDER BY seq))::INTEGER AS turn FROM m",
    "w10_current_turn": f"WITH {M_SQL}, l AS (SELECT session_id, max(seq) AS last FROM m WHERE role = 'user' GROUP BY 1) SELECT m.session_id, seq, role FROM m LEFT JOIN l ON l.session_id = m.session_id WHERE seq >= coalesce(last, -1) OR (role IN ('user', 'assistant') AND trim(coalesce(content, ''), ' ') <> '')",
    "w7_history": f"WITH {M_SQL}, r AS (SELECT session_id, seq FROM m QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 4) SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq)::INTEGER AS position FROM r",
    "j5_c3_sessions": f"WITH {M_SQL} SELECT s.session_id, n_messages, last.seq AS last_seq, last.role AS last_role, left(last.content, 120) AS preview FROM (SELECT session_id, count(*) AS n_messages FROM m GROUP BY 1) s LEFT JOIN LATERAL (SELECT * FROM m WHERE m.session_id = s.session_id ORDER BY seq DESC LIMIT 1) last ON true",
    "a9_token_usage": f"WITH {M_SQL}, l AS (SELECT session_id, max(seq) AS last FROM m WHERE role = 'user' GROUP BY 1) SELECT m.session_id, sum(length(content))::BIGINT AS input_tokens, coalesce(sum(seq) FILTER (seq % 2 = 0), 0)::BIGINT AS output_tokens, (sum(length(content)) + coalesce(sum(seq) FILTER (seq % 2 = 0), 0))::BIGINT AS total_tokens FROM m LEFT JOIN l ON l.session_id = m.session_id WHERE role = 'assistant' AND seq > coalesce(last, -1) AND m.session_id % 3 <> 0 GROUP BY 1",
    "a10_tool_budget": "WITH t AS (SELECT DISTINCT user_id AS session_id, day(ts)::INTEGER AS turn FROM events), l(tool, call_limit) AS (VALUES ('click', 2), ('view', 3), ('purchase', 1)), n AS (SELECT user_id AS session_id, day(ts)::INTEGER AS turn, event_type AS tool, count(*) AS n FROM events GROUP BY ALL) SELECT session_id, turn, tool, coalesce(n, 0) AS n_calls, call_limit, coalesce(n, 0) < call_limit AS available FROM t CROSS JOIN l LEFT JOIN n USING (session_id, turn, tool)",
    "c5_c8_tools_and_route": "SELECT event_id, concat_ws(',', CASE WHEN event_id % 3 < 2 THEN 'search_internal' END, CASE WHEN event_id % 3 > 0 THEN 'search_corpus' END, CASE WHEN event_id % 2 = 0 AND event_id % 5 <> 0 AND (event_type = 'error' OR (event_id % 3 > 0 AND event_id % 7 > 2)) THEN 'search_web' END, CASE WHEN event_id % 4 = 0 THEN 'manage_library' END) AS tools, CASE WHEN value > 50 THEN 'answer' WHEN event_id % 6 = 0 THEN 'refuse' WHEN event_id % 5 <> 0 THEN 'answer' ELSE 'refuse' END AS route FROM events",
    "t8_newest_clicks": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS rank FROM events WHERE event_type = 'click' QUALIFY rank <= 5",
    "w8_citation_numbers": "WITH e AS (SELECT user_id AS session_id, event_id AS position, event_type || '/' || (event_id % 4) AS key FROM events), f AS (SELECT *, min(position) OVER (PARTITION BY session_id, key) AS first FROM e) SELECT session_id, position, key, dense_rank() OVER (PARTITION BY session_id ORDER BY first)::INTEGER AS number FROM f",
    "t9_page_log": "SELECT user_id AS session_id, props->>'$.k' AS url, min(event_id) AS position FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY min(event_id) DESC) <= 20",
    "w5_c11_references": f"WITH {SEEN_SQL}, a AS (SELECT item_id AS ask_id, item_id % 10 AS session_id, CASE WHEN item_id % 2 = 0 THEN item_id % 3 END AS turn_hint, ['first', 'second', 'third', 'last', 'Title 1', 'title', 'Title 12', 'nothing'][(item_id // 4) % 8 + 1] AS hint FROM benchmark), s AS (SELECT a.*, url, title, row_number() OVER (PARTITION BY ask_id ORDER BY position) AS nth, row_number() OVER (PARTITION BY ask_id ORDER BY position DESC) AS back FROM a JOIN seen USING (session_id) WHERE turn_hint IS NULL OR turn = turn_hint), h AS (SELECT ask_id, url, CASE WHEN hint = 'first' AND nth = 1 OR hint = 'second' AND nth = 2 OR hint = 'third' AND nth = 3 OR hint = 'last' AND back = 1 THEN 1 WHEN hint IN ('first', 'second', 'third', 'last') THEN NULL WHEN lower(title) = lower(hint) THEN 1 WHEN contains(lower(title), lower(hint)) OR contains(lower(url), lower(hint)) THEN 2 END AS level FROM s), b AS (SELECT ask_id, url FROM h WHERE level IS NOT NULL QUALIFY level = min(level) OVER (PARTITION BY ask_id)) SELECT a.ask_id, CASE WHEN count(url) = 1 THEN min(url) END AS url, count(url) AS n_candidates FROM a LEFT JOIN b USING (ask_id) GROUP BY 1",
    "c9_trace_summary": f"WITH {SEEN_SQL}, t AS (SELECT session_id || '-' || turn AS call_id, title, min(position) AS first, count(*) AS n FROM seen GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY first) AS k FROM t) SELECT call_id, sum(n)::BIGINT AS n_results, string_agg(title, ' | ' ORDER BY first) FILTER (k <= 5) AS titles FROM r GROUP BY 1",
    "c10_filter_notice": "SELECT user_id AS session_id, event_id AS seq, nullif(last_value(CASE WHEN event_type = 'error' THEN 'n' || event_id WHEN event_type = 'purchase' THEN '' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), '') AS standing FROM events",
    "e14_new_ground": "WITH e AS (SELECT *, event_type || ':' || (event_id % 9) AS key FROM events) SELECT event_id AS call_id, NOT EXISTS (SELECT 1 FROM e s WHERE s.event_id % 2 = 0 AND s.user_id = e.user_id AND s.key = e.key) AS claims_new FROM e WHERE event_id % 2 = 1",
    "e15_evidence_texts": "SELECT d.doc_id AS number, md5(coalesce(CASE WHEN d.doc_id % 3 = 0 THEN d.text END, p.html, left(d.text, 500))) AS text_md5 FROM documents d LEFT JOIN pages p ON d.doc_id % 2 = 0 AND p.page_id = d.doc_id % 100",
    "c2_final_messages": f"WITH {M_SQL}, x AS (SELECT session_id * 1000 + seq AS message_id, content FROM m) SELECT message_id, md5(CASE WHEN message_id % 3 = 0 THEN content WHEN message_id % 2 = 0 THEN 'new ' || message_id WHEN message_id % 5 = 0 THEN content ELSE '' END) AS content_md5, CASE WHEN message_id % 3 = 0 THEN 'streaming' WHEN message_id % 5 = 0 THEN 'error' ELSE 'complete' END AS status FROM x",
    "e13_cited_tiers": "WITH c AS (SELECT item_id AS answer_id, item_id % 4 AS a, item_id % 3 AS b, unnest([0, 1, 2, 3]) AS number FROM benchmark), u AS (SELECT answer_id, number, CASE WHEN number = a THEN 0 ELSE 1 END AS place, a, b FROM c WHERE number IN (a, b)), t AS (SELECT answer_id, ['web', 'internal', 'full_corpus', 'full_corpus'][number + 1] AS tier, place, number = 2 AND 1 IN (a, b) AS gone FROM u) SELECT answer_id, tier, min(place)::INTEGER AS first_place FROM t WHERE NOT gone GROUP BY 1, 2",
    "f18_web_intent": f"WITH {PHRASE_SQL} SELECT query_id, query_id % 4 <> 1 AND (query_id % 8 = 3 OR query_id % 4 = 2 OR (query_id % 8 = 4)) AS requires_check, query_id % 4 = 0 AS requests_search FROM questions",
    "c7_fallback_action": "WITH e AS (SELECT event_id, [NULL, 'search_internal_documents', 'search_full_corpus', 'search_web', 'ask_user'][event_id % 5 + 1] AS l, value > 50 AS ok, event_type = 'click' AS w, event_id % 2 = 0 AS c, event_id % 3 = 0 AS b, event_id % 7 > 0 AS f FROM events) SELECT event_id, CASE WHEN event_id % 5 IN (1, 2) AND ok AND w AND b THEN 'search_web' WHEN event_id % 5 IN (1, 2, 3) AND ok THEN 'prepare_final_answer' WHEN event_id % 5 = 1 AND c THEN 'search_full_corpus' WHEN event_id % 5 = 4 AND b THEN 'search_web' WHEN event_id % 5 = 0 THEN 'search_internal_documents' WHEN f THEN 'prepare_final_answer' WHEN c THEN 'search_full_corpus' ELSE 'search_internal_documents' END AS action FROM e",
    "c1_started_turns": f"WITH {M_SQL}, l AS (SELECT session_id, max(seq) AS last, least(3, count(*)) AS n FROM m GROUP BY 1) SELECT l.session_id, last + k AS seq, CASE k WHEN 1 THEN 'user' ELSE 'assistant' END AS role, CASE k WHEN 1 THEN 'And ' || l.session_id || '?' ELSE '' END AS content, CASE k WHEN 1 THEN 'complete' ELSE 'streaming' END AS status, n AS n_history FROM l JOIN m ON m.session_id = l.session_id AND m.seq = 0, (VALUES (1), (2)) t(k)",
    "c4_transcript": f"WITH {M_SQL} SELECT session_id, seq, CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS n_citations, CASE WHEN seq % 3 = 0 THEN seq END::INTEGER AS first_number FROM m",
    "d18_status_view": f"WITH {LIBRARY_SQL.strip()} SELECT CASE status WHEN 'uploaded' THEN 'queued' WHEN 'ocr' THEN 'ocr' WHEN 'parsed' THEN 'chunking' WHEN 'annotated' THEN 'embedding' WHEN 'ready' THEN 'indexed' ELSE 'failed' END AS shown, CASE status WHEN 'uploaded' THEN 0 WHEN 'ocr' THEN 25 WHEN 'parsed' THEN 50 WHEN 'annotated' THEN 75 ELSE 100 END AS progress, count(*) AS n FROM library GROUP BY ALL",
    "x7_suggestions": "WITH k AS (SELECT conv_id AS group_id, turn AS position, role, text, regexp_replace(lower(text), '[^a-z0-9一-鿿]+', '', 'g') AS full_key, rtrim(left(trim(text, ' '), 60), ' ') AS short FROM conversations), c AS (SELECT group_id, position, short, regexp_replace(lower(short), '[^a-z0-9一-鿿]+', '', 'g') AS key FROM k), f AS (SELECT * FROM c WHERE key <> '' AND NOT EXISTS (SELECT 1 FROM k WHERE k.group_id = c.group_id AND (k.position = 0 OR (k.role = 'user' AND k.position % 4 = 1)) AND k.full_key = c.key) QUALIFY row_number() OVER (PARTITION BY group_id, key ORDER BY position) = 1) SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY position)::INTEGER AS kept, md5(short) AS text_md5 FROM f QUALIFY kept <= 3",
    "a16_recall": f"WITH {KNN_SQL}, f AS (SELECT case_id, min(rank) FILTER (relevant) AS r FROM ev GROUP BY 1) SELECT count(*) AS cases, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM f",
    "a17_acceptance": f"WITH {KNN_SQL}, c AS (SELECT case_id, coalesce(max(1 - distance) FILTER (relevant), 0) AS r, coalesce(max(1 - distance) FILTER (NOT relevant), 0) AS d FROM ev GROUP BY 1), a AS (SELECT avg((r > d)::INTEGER) AS top1, avg(r - d) AS margin, avg(r) AS relevant, avg(d) AS distractor FROM c) SELECT round(top1, 6) AS top1, round(margin, 6) AS margin, round(relevant, 6) AS relevant, round(distractor, 6) AS distractor, top1 >= 0.75 AND margin >= 0.05 AS accepted FROM a",
    "a18_calibration": f"WITH {KNN_SQL} SELECT count(*) AS cases, round(avg(((distance <= 0.6) = relevant)::INTEGER), 6) AS accuracy, round(min(distance) FILTER (relevant), 6) AS yes_min, round(max(distance) FILTER (relevant), 6) AS yes_max, round(avg(distance) FILTER (relevant), 6) AS yes_mean, round(min(distance) FILTER (NOT relevant), 6) AS no_min, round(max(distance) FILTER (NOT relevant), 6) AS no_max, round(avg(distance) FILTER (NOT relevant), 6) AS no_mean, round((max(distance) FILTER (relevant) + min(distance) FILTER (NOT relevant)) / 2, 6) AS midpoint FROM ev",
    "a19_two_stage": f"WITH {KNN_SQL}, a AS (SELECT case_id, max((rank <= 3 AND relevant)::INTEGER) AS hit FROM ev GROUP BY 1), b AS (SELECT case_id, relevant::INTEGER AS top FROM ev WHERE rank <= 3 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY round(doc_id % 7 - distance, 9) DESC, doc_id) = 1), r AS (SELECT avg(hit) AS recall, avg(coalesce(top, 0)) AS top1 FROM a LEFT JOIN b USING (case_id)) SELECT round(recall, 6) AS recall, round(top1, 6) AS top1, recall >= 1 AND top1 >= 0.75 AS accepted FROM r",
}
