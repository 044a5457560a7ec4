"""Metadata filters: inferred from questions, matched with documents, applied with fallback, described."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators import automaton, facets
from lodestack.storage import keep

# The phrases that ask for fresh sources, the wordings that name a source language, and other names of regions.
FRESHNESS = ("latest", "most recent", "current policy", "currently valid", "up to date", "up-to-date", "最新", "近期", "当前政策", "现行", "时效性")
LANGUAGES = {
    "English": (
        r"\b(?:documents?|files?|sources?|materials?).{0,50}\bin english\b",
        r"\benglish[- ]language (?:documents?|files?|sources?|materials?)\b",
        r"\benglish (?:documents?|files?|sources?|materials?)\b",
        "英文文件",
        "英文资料",
        "英文来源",
    ),
    "Chinese": (
        r"\b(?:documents?|files?|sources?|materials?).{0,50}\bin chinese\b",
        r"\bchinese[- ]language (?:documents?|files?|sources?|materials?)\b",
        r"\bchinese (?:documents?|files?|sources?|materials?)\b",
        "中文文件",
        "中文资料",
        "中文来源",
    ),
    "French": (
        r"\b(?:documents?|files?|sources?|materials?).{0,50}\bin french\b",
        r"\bfrench[- ]language (?:documents?|files?|sources?|materials?)\b",
        "法文文件",
        "法文资料",
        "法文来源",
    ),
    "Spanish": (
        r"\b(?:documents?|files?|sources?|materials?).{0,50}\bin spanish\b",
        r"\bspanish[- ]language (?:documents?|files?|sources?|materials?)\b",
        "西班牙语文件",
        "西班牙语资料",
    ),
}
REGION_ALIASES = {
    "Australia": ("澳大利亚", "澳洲"),
    "Canada": ("加拿大",),
    "China": ("中国", "中华人民共和国"),
    "Côte d'Ivoire": ("科特迪瓦",),
    "European Union": ("欧盟",),
    "France": ("法国",),
    "Singapore": ("新加坡",),
    "South Africa": ("南非",),
    "United States": ("美国", "美利坚合众国"),
}
YEAR = "((?:19|20)[0-9]{2})"


def years(question: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(question, F.lit(pattern), F.lit(1)), lambda y: y.cast("int"))


def year_bounds(question: Column) -> Column:
    """struct(year_from, year_to): a filtering clause wins, then before or after alone, then since and through, then the years named."""
    clause = years(question, rf"(?i)(?:filter|exclude|only|files?|documents?).{{0,60}}?(?:before|earlier than|prior to)\s+{YEAR}")
    before = years(question, rf"(?i)\b(?:before|earlier than|prior to)\s+{YEAR}\b")
    after = years(question, rf"(?i)\b(?:after|later than)\s+{YEAR}\b")
    since = years(question, rf"(?i)\b(?:since|from)\s+{YEAR}\b")
    through = years(question, rf"(?i)\b(?:through|until|up to)\s+{YEAR}\b")
    named = years(question, rf"\b{YEAR}\b")
    some = lambda a: F.size(a) > 0
    none = F.lit(None).cast("int")
    pair = lambda a, b: F.struct(a.alias("year_from"), b.alias("year_to"))
    return (
        F.when(some(clause), pair(none, F.try_element_at(clause, F.lit(-1)) - 1))
        .when(some(before) & ~some(after), pair(none, F.array_min(before) - 1))
        .when(some(after) & ~some(before), pair(F.array_max(after) + 1, none))
        .when(some(since) | some(through), pair(F.array_min(since), F.array_max(through)))
        .otherwise(pair(F.array_min(named), F.array_max(named)))
    )


def label_patterns(labels: DataFrame, value: str = "value") -> DataFrame:
    """(label, pattern) of labels, in lower case: each label of four characters or more, and a region's other names."""
    label = F.trim(value)
    aliases = reduce(lambda acc, item: acc.when(label == item[0], F.array(*[F.lower(F.lit(a)) for a in item[1]])), REGION_ALIASES.items(), F.when(F.lit(False), F.array(F.lit(""))))
    names = F.concat(F.array(F.lower(label)), F.coalesce(aliases, F.array().cast("array<string>")))
    return labels.select(label.alias("label"), F.explode(F.when(F.length(label) >= 4, names)).alias("pattern"))


def unique(values: Column) -> Column:
    """The first of values equal but for case and outer spaces, in order; blanks and nulls go."""
    clean = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: F.length(v) > 0)
    return F.filter(clean, lambda v, i: F.array_position(F.transform(clean, lambda x: F.lower(x)), F.lower(v)) == i + 1)


#: What may be given beside a question: one value of each kind, some tags, and years.
GIVEN = {"policy_area": "string", "country_or_region": "string", "source_organisation": "string", "language": "string", "tags": "array<string>", "published_year_from": "int", "published_year_to": "int"}


def infer(questions: DataFrame, labels: DataFrame, this_year: int, given: DataFrame | None = None) -> DataFrame:
    """Filters for questions(query_id, question): the five lists, year_from, year_to, freshness.

    labels(dimension, value) holds the distinct values of the catalogue, which are few (facets); one automaton finds those that a question names. given(query_id, and
    any of GIVEN) has what was chosen outright: it stands before what the question names, and a given year, either, leaves the question's years unread. Freshness sets the
    first year where there is none.
    """
    q = F.col("question")
    named = labels.where(F.col("dimension").isin(*list(facets.DIMENSIONS)[:3]))
    hits = automaton.contained(questions, ["query_id"], F.lower("question"), label_patterns(named).distinct())
    hits = hits.join(named.select("dimension", F.trim("value").alias("label")).distinct(), "label").groupBy("query_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("dimension") == d, F.col("label")))).alias(d) for d in list(facets.DIMENSIONS)[:3]])
    empty = F.array().cast("array<string>")
    languages = F.array_compact(F.array(*[F.when(F.lower(q).rlike("|".join(p)), F.lit(name)) for name, p in LANGUAGES.items()]))
    tags = F.regexp_extract_all(q, F.lit(r"(?i)(?:\btag|标签)\s*[:：]\s*([\p{L}\p{N}_ -]+)"), F.lit(1))
    fresh = F.lower(q).rlike("|".join(FRESHNESS))
    out = questions.join(hits, "query_id", "left").withColumn("y", year_bounds(q))
    have = set() if given is None else set(given.columns)
    if given is not None:
        out = out.join(given.select("query_id", *[F.col(c).alias(f"given_{c}") for c in GIVEN if c in have]), "query_id", "left")
    own = {c: F.col(f"given_{c}").cast(t) if c in have else F.lit(None).cast(t) for c, t in GIVEN.items()}
    first = {"policy_areas": F.array(own["policy_area"]), "country_regions": F.array(own["country_or_region"]), "source_organisations": F.array(own["source_organisation"]), "languages": F.array(own["language"]), "tags": F.coalesce(own["tags"], empty)}
    read = {**{d: F.coalesce(d, empty) for d in list(facets.DIMENSIONS)[:3]}, "languages": languages, "tags": tags}
    dated = own["published_year_from"].isNotNull() | own["published_year_to"].isNotNull()
    year_from, year_to = F.when(dated, own["published_year_from"]).otherwise(F.col("y.year_from")), F.when(dated, own["published_year_to"]).otherwise(F.col("y.year_to"))
    return out.select("query_id", *[unique(F.concat(first[d], read[d])).alias(d) for d in facets.DIMENSIONS], F.when(fresh & year_from.isNull(), F.lit(this_year - 5)).otherwise(year_from).alias("year_from"), year_to.alias("year_to"), fresh.alias("freshness"))


def active() -> Column:
    return reduce(lambda a, b: a | b, [F.size(d) > 0 for d in facets.DIMENSIONS]) | F.col("year_from").isNotNull() | F.col("year_to").isNotNull()


def describe() -> Column:
    part = lambda label, d: F.when(F.size(d) > 0, F.concat(F.lit(label + "="), F.array_join(d, ", ")))
    a, b = F.col("year_from"), F.col("year_to")
    year = F.when(a == b, F.concat(F.lit("year="), a.cast("string"))).otherwise(F.concat_ws("; ", F.concat(F.lit("year>="), a.cast("string")), F.concat(F.lit("year<="), b.cast("string"))))
    parts = F.concat_ws("; ", part("policy area", "policy_areas"), part("region", "country_regions"), part("organisation", "source_organisations"), part("language", "languages"), part("tag", "tags"), F.nullif(year, F.lit("")))
    return F.when(parts == "", "none").otherwise(parts)


def notice(description: Column, applied: Column, fallback: Column, fresh: Column) -> Column:
    stale = F.concat(F.lit("No documents matched the requested current/recent filter ("), description, F.lit("). The search was expanded to the original document scope; older sources may no longer reflect current policy."))
    wide = F.concat(F.lit("No documents matched the requested metadata filters ("), description, F.lit("). The search was expanded to the original document scope, so the returned sources may not satisfy every requested constraint."))
    return F.when(~applied, None).when(~fallback, F.concat(F.lit("Applied document metadata filters: "), description, F.lit("."))).when(fresh, stale).otherwise(wide)


def match_counts(filters: DataFrame, docs: DataFrame | facets.FacetIndex) -> DataFrame:
    """(query_id, applied, fallback, n_matched, description, notice): how many documents each query's filters leave, and the fallback if none.

    Filters that ask for nothing leave all documents. docs is a facet index, or what one is made of.
    """
    filters = keep(filters, "filters")
    index = docs if isinstance(docs, facets.FacetIndex) else facets.FacetIndex(docs)
    found = facets.hits(filters, index).groupBy("query_id").agg(F.count("*").alias("n"))
    out = filters.withColumn("description", describe()).withColumn("applied", active()).join(found, "query_id", "left").withColumn("n_matched", F.coalesce("n", F.when(F.col("applied"), 0).otherwise(F.lit(index.docs.count()))))
    fallback = F.col("applied") & (F.col("n_matched") == 0)
    return out.select("query_id", "applied", fallback.alias("fallback"), "n_matched", "description", notice(F.col("description"), F.col("applied"), fallback, F.col("freshness")).alias("notice"))


def missing_regions(asked: DataFrame, cited: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, region) of asked(query_id, region) without a cited document of the region and without a cited text that names it.

    cited(query_id, doc_id, text), docs(doc_id, country_region). Each cited text is read once, for all regions asked for.
    """
    of_region = cited.join(docs.select("doc_id", F.col("country_region").alias("region")), "doc_id").select("query_id", "region").distinct()
    texts = cited.join(asked.select("query_id").distinct(), "query_id", "left_semi")
    named = automaton.contained(texts, ["query_id"], F.lower("text"), label_patterns(asked.select("region").distinct(), "region")).distinct()
    rows = asked.join(of_region, ["query_id", "region"], "left_anti")
    return rows.join(named, (rows["query_id"] == named["query_id"]) & (F.trim(rows["region"]) == named["label"]), "left_anti")


def supplement(kept: DataFrame, extra: DataFrame) -> DataFrame:
    """kept(query_id, doc_id, position) and, behind them, the rows of extra(query_id, region, doc_id, rank) that aren't there yet."""
    from pyspark.sql import Window as W

    new = extra.join(kept.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").groupBy("query_id", "doc_id").agg(F.min(F.struct("region", "rank")).alias("first"))
    last = kept.groupBy("query_id").agg(F.max("position").alias("last"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("first.region", "first.rank", "doc_id"))
    return kept.select("query_id", "doc_id", "position").unionByName(new.join(last, "query_id", "left").select("query_id", "doc_id", (F.coalesce("last", F.lit(0)) + place).alias("position")))
