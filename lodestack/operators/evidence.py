"""The deterministic evidence gate: chunk relevance, sufficiency, context, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.functions.text import lexical_coverage, lexical_matches, unsupported_instrument

MAX_DISTANCE = 0.45
MIN_RERANK = -2.0
MIN_CONTEXT = 200
CONTEXT_BUDGET = 200_000
NO_TEXT = "No extractable text was found in the selected documents."
LOW_RELEVANCE = "The selected documents do not contain passages closely related to your question."
SHORT_CONTEXT = "Too little relevant text was retrieved to support a reliable answer."


def is_relevant(question: Column, text: Column, distance: Column, score: Column, max_distance: float = MAX_DISTANCE, min_score: float = MIN_RERANK) -> Column:
    """Near enough and not rejected by the reranker; farther chunks need words in common, more of them without a reranker."""
    matches, coverage = lexical_matches(question, text), lexical_coverage(question, text)
    passes = score.isNull() | (score >= min_score)
    lexical = (matches >= 2) & (coverage >= 0.30)
    return F.when(F.coalesce(distance, F.lit(1.0)) <= max_distance, passes).otherwise(lexical & F.when(score.isNotNull(), passes).otherwise((matches >= 3) & (coverage >= 0.60)))


def context(chunks: DataFrame, budget: int = CONTEXT_BUDGET) -> DataFrame:
    """(query_id, context, truncated, n_citations) of chunks(query_id, position, file, page, text).

    Blocks `[n] file, page p` and text, n the position with empty texts counted, are joined while their lengths fit the budget; the one that
    crosses it is cut. Separators are free.
    """
    label = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), F.col("file"), F.when(F.col("page").isNotNull(), F.concat(F.lit(", page "), F.col("page").cast("string"))).otherwise(F.lit("")))
    blocks = chunks.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).withColumn("block", F.concat(label, F.lit("\n"), F.trim("text")))
    before = F.coalesce(F.sum(F.length("block")).over(W.partitionBy("query_id").orderBy("position").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = blocks.withColumn("left", F.lit(budget) - before).where("left > 0").withColumn("kept", F.expr("substring(block, 1, cast(left as int))"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "kept"))), lambda x: x["kept"]), "\n\n---\n\n")
    return cut.groupBy("query_id").agg(joined.alias("context"), F.bool_or(F.length("block") > F.col("left")).alias("truncated"), F.count("*").alias("n_citations"))


def assess(questions: DataFrame, chunks: DataFrame, contexts: DataFrame, pages: DataFrame | None = None, max_distance: float = MAX_DISTANCE, min_score: float = MIN_RERANK) -> DataFrame:
    """(query_id, sufficient, reason) for questions(query_id, question, has_embeddings).

    chunks(query_id, position, text, distance, reranker_score); contexts(query_id, context); pages(query_id, position, text) serve where there are no embeddings.
    """
    judged = chunks.join(questions.select("query_id", "question"), "query_id").withColumn("relevant", is_relevant(F.col("question"), F.col("text"), F.col("distance"), F.col("reranker_score"), max_distance, min_score))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("relevant"), F.struct("position", F.coalesce("text", F.lit("")).alias("text"))))), lambda x: x["text"]), "\n")
    seen = judged.groupBy("query_id").agg(F.count_if("relevant").alias("n_relevant"), texts.alias("evidence"))
    out = questions.join(seen, "query_id", "left").join(contexts.select("query_id", "context"), "query_id", "left")
    if pages is None:
        out = out.withColumn("page_text", F.lit(None).cast("string"))
    else:
        paged = pages.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n").alias("page_text"))
        out = out.join(paged, "query_id", "left")
    short = F.length(F.trim(F.coalesce("context", F.lit("")))) < MIN_CONTEXT
    named = unsupported_instrument(F.col("question"), F.concat_ws("\n", "context", "evidence"))
    named_pages = unsupported_instrument(F.col("question"), F.when(short, F.col("page_text")).otherwise(F.trim("context")))
    missing = lambda name: F.concat(F.lit('The retrieved passages do not mention the explicitly named instrument "'), name, F.lit('".'))
    with_vectors = F.when(F.coalesce("n_relevant", F.lit(0)) == 0, F.lit(LOW_RELEVANCE)).when(named.isNotNull(), missing(named)).when(short, F.lit(SHORT_CONTEXT))
    enough_pages = F.length(F.coalesce("page_text", F.lit(""))) >= MIN_CONTEXT
    without = F.when(short & ~enough_pages, F.lit(NO_TEXT)).when(named_pages.isNotNull(), missing(named_pages))
    out = out.withColumn("reason", F.when(F.col("has_embeddings"), with_vectors).otherwise(without))
    return out.select("query_id", F.col("reason").isNull().alias("sufficient"), "reason")


def citations(chunks: DataFrame, quote: int = 500) -> DataFrame:
    """Numbered citations of chunks(query_id, position, doc_id, page, text): the page and the beginning of the text."""
    return chunks.select("query_id", F.col("position").alias("number"), "doc_id", "page", F.substring("text", 1, quote).alias("quote"))


def validate_questions(candidates: DataFrame, distances: DataFrame, max_distance: float, limit: int, scores: DataFrame | None = None, min_score: float = MIN_RERANK) -> DataFrame:
    """candidates(group_id, position, question) whose nearest chunk, and best rerank score if given, pass; the first `limit` of each group.

    distances(group_id, position, distance), scores(group_id, position, reranker_score). A candidate without chunks fails.
    """
    near = distances.groupBy("group_id", "position").agg(F.min("distance").alias("best"))
    out = candidates.join(near, ["group_id", "position"]).where(F.col("best") <= max_distance)
    if scores is not None:
        top = scores.groupBy("group_id", "position").agg(F.max("reranker_score").alias("top"))
        out = out.join(top, ["group_id", "position"]).where(F.col("top") >= min_score)
    order = W.partitionBy("group_id").orderBy("position")
    return out.withColumn("kept", F.row_number().over(order)).where(F.col("kept") <= limit).select("group_id", "position", "question", "best", "kept")


def web_gate(scored: DataFrame, max_distance: float, min_score: float | None = None) -> DataFrame:
    """One row for each url of scored(query_id, url, ordinal, text, distance, reranker_score): its nearest chunk and whether it passes.

    The first chunk wins ties. With min_score a missing score fails.
    """
    best = scored.groupBy("query_id", "url").agg(F.min_by(F.struct("text", "distance", "reranker_score"), F.struct(F.round("distance", 9), "ordinal")).alias("best")).select("query_id", "url", "best.*")
    passed = F.col("distance") <= max_distance
    if min_score is not None:
        passed = passed & F.coalesce(F.col("reranker_score") >= min_score, F.lit(False))
    return best.withColumn("passed", passed)


def cited_tiers(answers: DataFrame, citations_: DataFrame) -> DataFrame:
    """(answer_id, tier, first_number) of the citations that an answer's [n] markers name, in order of first mention.

    answers(answer_id, answer), citations(answer_id, number, tier, doc_id). A full_corpus citation of a document that an internal one names too is dropped.
    """
    marks = answers.select("answer_id", F.posexplode(F.regexp_extract_all("answer", F.lit(r"\[(\d{1,9})\]"), F.lit(1))).alias("place", "mark")).select("answer_id", "place", F.col("mark").cast("int").alias("number"))
    used = citations_.join(marks.groupBy("answer_id", "number").agg(F.min("place").alias("place")), ["answer_id", "number"])
    internal = used.where("tier = 'internal'").select("answer_id", "doc_id").distinct()
    dropped = used.where("tier = 'full_corpus'").join(internal, ["answer_id", "doc_id"], "left_semi").select("answer_id", "number")
    return used.join(dropped, ["answer_id", "number"], "left_anti").groupBy("answer_id", "tier").agg(F.min("place").alias("first_place"))
