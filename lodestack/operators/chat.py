"""Conversation operators: turns, history, sessions, usage, budgets, citations, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.operators.running import running


def turn_index(messages: DataFrame) -> DataFrame:
    """messages(session_id, seq, role, ...) with turn: the user messages so far."""
    return running(messages, ["session_id"], ["seq"], {"turn": (F.col("role") == "user").cast("int")})


def _with_last_question(messages: DataFrame) -> DataFrame:
    """messages with last, the seq of their session's last user message: an aggregate that is joined back, so no session is held together."""
    last = messages.where(F.col("role") == "user").groupBy("session_id").agg(F.max("seq").alias("last"))
    return messages.join(last, "session_id", "left")


def current_turn(messages: DataFrame, plain=("user", "assistant")) -> DataFrame:
    """From the last user message on everything; before it plain conversation with text."""
    kept = (F.col("seq") >= F.coalesce("last", F.lit(-1))) | (F.col("role").isin(*plain) & (F.length(F.trim(F.coalesce("content", F.lit("")))) > 0))
    return _with_last_question(messages).where(kept).drop("last")


def history(messages: DataFrame, n: int = 10) -> DataFrame:
    """The n newest messages of each session; position counts them in the order they were sent."""
    newest = F.row_number().over(W.partitionBy("session_id").orderBy(F.col("seq").desc()))
    kept = messages.withColumn("newest", newest).where(F.col("newest") <= n)
    return kept.withColumn("position", F.row_number().over(W.partitionBy("session_id").orderBy("seq"))).drop("newest")


def sessions(messages: DataFrame, preview: int = 120) -> DataFrame:
    """(session_id, n_messages, last_role, preview): the last message of each session by one aggregate."""
    last = F.max_by(F.struct("role", "content"), "seq")
    out = messages.groupBy("session_id").agg(F.count("*").alias("n_messages"), F.max("seq").alias("last_seq"), last.alias("last"))
    return out.select("session_id", "n_messages", "last_seq", F.col("last.role").alias("last_role"), F.substring("last.content", 1, preview).alias("preview"))


def token_usage(messages: DataFrame) -> DataFrame:
    """Tokens of assistant messages after the last user message, for sessions that report any; messages(session_id, seq, role, input_tokens, output_tokens)."""
    after = _with_last_question(messages).where((F.col("role") == "assistant") & (F.col("seq") > F.coalesce("last", F.lit(-1))) & (F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long")
    return after.groupBy("session_id").agg(total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens")).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def tool_budget(calls: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(session_id, turn, tool, n_calls, call_limit, available) of calls(session_id, turn, tool): a row of each turn for each tool that has a limit."""
    used = calls.groupBy("session_id", "turn").agg(*[F.count_if(F.col("tool") == tool).alias(f"n_{i}") for i, tool in enumerate(limits)])
    rows = F.explode(F.array(*[F.struct(F.lit(tool).alias("tool"), F.col(f"n_{i}").alias("n_calls"), F.lit(limit).alias("call_limit")) for i, (tool, limit) in enumerate(limits.items())]))
    return used.select("session_id", "turn", rows.alias("r")).select("session_id", "turn", "r.*").withColumn("available", F.col("n_calls") < F.col("call_limit"))


def tools_for(admin: Column, mode: Column, counts: Column, limits: dict[str, int], admin_only=("manage_library",), chat_only=("search_web",)) -> Column:
    """The tools left: none over its limit in the map counts, administrators' and chat mode's own ones only there."""
    out = []
    for tool, limit in limits.items():
        ok = F.coalesce(F.try_element_at(counts, F.lit(tool)), F.lit(0)) < limit
        ok = ok & admin if tool in admin_only else ok & (mode == "chat") if tool in chat_only else ok
        out.append(F.when(ok, F.lit(tool)))
    return F.array_compact(F.array(*out))


def tier_order(tools: Column, tried_internal: Column, tried_corpus: Column, web_asked: Column) -> Column:
    """The ladder internal, full corpus, web: a tier opens when the one before it was tried; web at once if it is asked for."""
    return F.filter(tools, lambda t: F.when(t == "search_corpus", tried_internal).when(t == "search_web", web_asked | (tried_internal & tried_corpus)).otherwise(True))


def route(sufficient: Column, mode: Column, response: Column) -> Column:
    return F.when(sufficient, "answer").when(response == "policymaker", "refuse").when(mode == "chat", "answer").otherwise("refuse")


def finalised(messages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """messages(message_id, content, status, ...) after outcomes(message_id, new_content, failed): a failure never blanks what is there."""
    out = messages.join(outcomes, "message_id", "left")
    content = F.when(F.col("failed"), F.coalesce(F.nullif("new_content", F.lit("")), F.col("content"))).otherwise(F.coalesce("new_content", "content"))
    status = F.when(F.col("failed").isNull(), F.col("status")).when(F.col("failed"), "error").otherwise("complete")
    return out.withColumns({"content": content, "status": status}).drop("new_content", "failed")


def numbered_citations(citations: DataFrame) -> DataFrame:
    """citations(session_id, position, key) with number: equal keys share one, new keys get the next in order of first sight."""
    first = citations.groupBy("session_id", "key").agg(F.min("position").alias("first"))
    numbered = running(first, ["session_id"], ["first", "key"], {"number": F.lit(1)})
    return citations.join(numbered.drop("first"), ["session_id", "key"])


def pages_seen(rows: DataFrame, cap: int = 50) -> DataFrame:
    """rows(session_id, position, url): the first of each url, the newest `cap` of those."""
    first = rows.groupBy("session_id", "url").agg(F.min("position").alias("position"))
    newest = F.row_number().over(W.partitionBy("session_id").orderBy(F.col("position").desc()))
    return first.withColumn("n", newest).where(F.col("n") <= cap).drop("n")


ORDINALS = {"first": 1, "second": 2, "third": 3, "last": -1}


def resolve_reference(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """(ask_id, url, n_candidates) for asked(ask_id, session_id, turn_hint, hint) over pages(session_id, turn, position, url, title).

    An ordinal picks by position, in the hinted turn if one is given. Else an exact title beats a title or url that contains the hint; url is null unless one candidate is left.
    """
    scoped = asked.join(pages, "session_id").where(F.col("turn_hint").isNull() | (F.col("turn") == F.col("turn_hint")))
    w = W.partitionBy("ask_id").orderBy("position")
    ranked = scoped.withColumn("nth", F.row_number().over(w)).withColumn("back", F.row_number().over(W.partitionBy("ask_id").orderBy(F.col("position").desc())))
    hint = F.lower(F.trim("hint"))
    ordinal = F.coalesce(*[F.when(hint == name, F.lit(k)) for name, k in ORDINALS.items()])
    by_place = F.when(ordinal > 0, F.col("nth") == ordinal).otherwise(F.col("back") == 1)
    exact = F.lower("title") == hint
    loose = F.contains(F.lower("title"), hint) | F.contains(F.lower("url"), hint)
    level = F.when(ordinal.isNotNull(), F.when(by_place, 1)).when(exact, 1).when(loose, 2)
    hits = ranked.withColumn("level", level).where("level is not null")
    best = hits.groupBy("ask_id").agg(F.min("level").alias("best"))
    counted = hits.join(best, "ask_id").where("level = best").groupBy("ask_id").agg(F.count("*").alias("n_candidates"), F.min("url").alias("url"))
    out = asked.select("ask_id").join(counted, "ask_id", "left")
    return out.select("ask_id", F.when(F.col("n_candidates") == 1, F.col("url")).alias("url"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def trace_summary(results: DataFrame, n: int = 5) -> DataFrame:
    """(call_id, n_results, titles): the first n distinct titles of results(call_id, position, title), ranked before they are listed."""
    seen = results.groupBy("call_id", "title").agg(F.min("position").alias("first"), F.count("*").alias("n"))
    counts = seen.groupBy("call_id").agg(F.sum("n").alias("n_results"))
    ranked = seen.where("title is not null").withColumn("nth", F.row_number().over(W.partitionBy("call_id").orderBy("first", "title"))).where(F.col("nth") <= n)
    titles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "title"))), lambda x: x["title"]), " | ")
    return counts.join(ranked.groupBy("call_id").agg(titles.alias("titles")), "call_id", "left").select("call_id", "n_results", F.coalesce("titles", F.lit("")).alias("titles"))


def filter_notice(events: DataFrame) -> DataFrame:
    """The notice standing after each of events(session_id, seq, fallback, notice, satisfied): set by a fallback, cleared when a tier is satisfied without one."""
    change = F.when(F.col("fallback"), F.struct(F.col("notice").alias("n"))).when(F.col("satisfied"), F.struct(F.lit(None).cast("string").alias("n")))
    return running(events, ["session_id"], ["seq"], lasts={"standing": change}).withColumn("standing", F.col("standing")["n"])


def new_ground(seen: DataFrame, raised: DataFrame) -> DataFrame:
    """(call_id, claims_new) of raised(call_id, session_id, key): whether any key is unseen in seen(session_id, key)."""
    fresh = raised.join(seen.select("session_id", "key").distinct(), ["session_id", "key"], "left_anti").select("call_id", F.lit(True).alias("claims_new")).distinct()
    return raised.select("call_id").distinct().join(fresh, "call_id", "left").select("call_id", F.coalesce("claims_new", F.lit(False)).alias("claims_new"))


def evidence_texts(numbered: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """numbered(number, chunk_id, url, quote) with text: by chunk_id from chunks(chunk_id, text), else by url from pages(url, text), else the quote."""
    out = numbered.join(chunks.select("chunk_id", F.col("text").alias("by_chunk")), "chunk_id", "left").join(pages.select("url", F.col("text").alias("by_url")), "url", "left")
    return out.withColumn("text", F.coalesce("by_chunk", "by_url", "quote")).drop("by_chunk", "by_url")


# Words by which a question asks for fresh facts, a comparison, names the web, forbids or requests a web search.
FRESH = ("up to date", "up-to-date", "still accurate", "still current", "latest", "newest", "most recent", "newer", "最新", "最近更新", "是否仍然有效", "是否仍有效", "是否仍然适用", "是否过时", "现行")
COMPARISON = ("对比", "比对", "核实", "核对", "compare", "cross-check", "cross check", "verify")
WEB_WORDS = ("web", "online", "internet", "网页", "网站", "网上", "上网", "联网", "互联网")
OPT_OUT = ("do not search the web", "don't search the web", "no web search", "without web search", "offline only", "不要搜索网页", "不要上网", "不要联网", "不需要联网", "无需联网", "仅使用文档", "只使用文档")
REQUESTS = ("search the web", "search the internet", "search online", "look it up online", "look this up online", "check online", "check the web", "google", "上网搜", "上网查", "网上搜", "网上查", "联网搜索", "联网查", "搜索网页", "搜一下网", "帮我上网")


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def requires_web_check(question: Column) -> Column:
    """Fresh facts, or a comparison that names the web, unless the question forbids a web search."""
    q = F.lower(F.coalesce(question, F.lit("")))
    return ~_has(q, OPT_OUT) & (_has(q, FRESH) | (_has(q, COMPARISON) & _has(q, WEB_WORDS)))


def requests_web_search(question: Column) -> Column:
    q = F.lower(F.coalesce(question, F.lit("")))
    return ~_has(q, OPT_OUT) & _has(q, REQUESTS)


def fallback_action(last_tool: Column, sufficient: Column, web_check: Column, allowed: Column) -> Column:
    """The next tool where a model names none: up the ladder of evidence tiers, and to the answer where that ends.

    last_tool is null before the first call; allowed is an array of names.
    """
    may = lambda tool: F.array_contains(allowed, tool)
    documents = last_tool.isin("search_internal_documents", "search_full_corpus")
    tier = documents | (last_tool == "search_web")
    yes = F.coalesce(sufficient, F.lit(False))
    return (
        F.when(documents & yes & web_check & may("search_web"), "search_web")
        .when(tier & yes, "prepare_final_answer")
        .when((last_tool == "search_internal_documents") & may("search_full_corpus"), "search_full_corpus")
        .when((last_tool == "ask_user") & may("search_web"), "search_web")
        .when(last_tool.isNull() & may("search_internal_documents"), "search_internal_documents")
        .when(may("prepare_final_answer"), "prepare_final_answer")
        .otherwise(F.get(F.array_sort(allowed), F.lit(0)))
    )


def started_turns(messages: DataFrame, requests: DataFrame, n: int = 10) -> DataFrame:
    """New rows for requests(session_id, question) that have a session: the question and a pending answer behind the session's last message.

    history is what a model gets: the newest n messages from before, oldest first, as JSON.
    """
    old = history(messages, n).groupBy("session_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("position", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))).alias("history"))
    last = messages.groupBy("session_id").agg(F.max("seq").alias("last"))
    rows = requests.join(last, "session_id").join(old, "session_id", "left")
    new = F.array(F.struct((F.col("last") + 1).alias("seq"), F.lit("user").alias("role"), F.col("question").alias("content"), F.lit("complete").alias("status")), F.struct((F.col("last") + 2).alias("seq"), F.lit("assistant").alias("role"), F.lit("").alias("content"), F.lit("streaming").alias("status")))
    return rows.select("session_id", "history", F.explode(new).alias("m")).select("session_id", "history", "m.*")


def transcript(messages: DataFrame, json_column: str, schema: str) -> DataFrame:
    """messages with a JSON column read as an array; what can't be read is an empty one."""
    return messages.withColumn(json_column, F.coalesce(F.from_json(json_column, schema), F.from_json(F.lit("[]"), schema)))


STATUS_VIEW = {"uploaded": ("queued", 0), "ocr": ("ocr", 25), "parsed": ("chunking", 50), "annotated": ("embedding", 75), "ready": ("indexed", 100), "failed": ("failed", 100)}


def status_view(status: Column) -> Column:
    """struct(shown, progress) of a document's processing status."""
    out = None
    for name, (shown, progress) in STATUS_VIEW.items():
        value = F.struct(F.lit(shown).alias("shown"), F.lit(progress).alias("progress"))
        out = F.when(status == name, value) if out is None else out.when(status == name, value)
    return out.otherwise(F.struct(F.lit("queued").alias("shown"), F.lit(0).alias("progress")))
