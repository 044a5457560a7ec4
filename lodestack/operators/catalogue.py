"""Catalogue operators: filters, search, facets, orders, pages, lookups, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEARCH_FIELDS = ("title", "original_filename", "summary", "source_type", "source_organisation", "country_region", "policy_areas", "keywords", "year")


def exact_filters(docs: DataFrame, *, include_restricted: bool = False, policy_area=None, country=None, organisation=None, tag=None, status=None, source_type=None) -> DataFrame:
    """Visibility unless include_restricted, and each filter that is given: equality, or membership for areas and tags."""
    tests = [] if include_restricted else [F.col("approved") & (F.col("access_level") == "public")]
    tests += [F.array_contains("policy_areas", policy_area)] if policy_area else []
    tests += [F.array_contains("keywords", tag)] if tag else []
    tests += [F.col(c) == v for c, v in (("country_region", country), ("source_organisation", organisation), ("status", status), ("source_type", source_type)) if v]
    return reduce(lambda df, t: df.where(t), tests, docs)


def search(docs: DataFrame, query: str) -> DataFrame:
    """Rows with the query, in any case and taken literally, in one of nine fields; arrays count as space-joined. Blank: all rows."""
    needle = query.strip().lower()
    if not needle:
        return docs
    shown = lambda c: F.array_join(c, " ") if c in ("policy_areas", "keywords") else F.col(c).cast("string")
    hits = [F.coalesce(F.contains(F.lower(shown(c)), F.lit(needle)), F.lit(False)) for c in SEARCH_FIELDS]
    return docs.where(reduce(lambda a, b: a | b, hits))


def match_fields(query: str) -> Column:
    """The names of the fields that contain the query; arrays count in their list notation, as a reader of them would see it."""
    needle = query.strip().lower()

    def shown(c):
        if c in ("policy_areas", "keywords"):
            return F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))
        return F.col(c).cast("string")

    return F.array_compact(F.array(*[F.when(F.contains(F.lower(shown(c)), F.lit(needle)), F.lit(c)) for c in SEARCH_FIELDS]))


ORDERS = {
    "uploaded_desc": lambda: [F.col("uploaded_at").desc_nulls_last(), F.col("doc_id")],
    "name_asc": lambda: [F.lower(F.coalesce("title", "original_filename")).asc_nulls_last(), F.col("doc_id")],
    "year_desc": lambda: [F.col("year").desc_nulls_last(), F.col("doc_id")],
    "chunks_desc": lambda: [F.col("chunk_count").desc_nulls_last(), F.col("doc_id")],
}


def page_of(docs: DataFrame, order: str = "uploaded_desc", page: int = 1, size: int = 20) -> DataFrame:
    """One page in a named order (an unknown name is the first); page from 1, size 1 to 100."""
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page from 1, size from 1 to 100")
    return docs.orderBy(*ORDERS.get(order, ORDERS["uploaded_desc"])()).offset((page - 1) * size).limit(size)


def totals(docs: DataFrame, size: int) -> DataFrame:
    return docs.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


def with_counts(docs: DataFrame, **children: DataFrame) -> DataFrame:
    """docs with the number of rows of each child(doc_id, ...), counted before the join; 0 where there are none."""
    for name, child in children.items():
        docs = docs.join(child.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return docs


def lookup(identifiers: DataFrame, docs: DataFrame) -> DataFrame:
    """(identifier, doc_id) for identifiers(identifier): by id, or by file name, the newest upload first; null where nothing matches."""
    by_id = docs.select(F.col("doc_id").cast("string").alias("identifier"), "doc_id", "uploaded_at")
    by_name = docs.select(F.col("original_filename").alias("identifier"), "doc_id", "uploaded_at")
    newest = by_id.unionByName(by_name).groupBy("identifier").agg(F.max_by("doc_id", F.struct("uploaded_at", "doc_id")).alias("doc_id"))
    return identifiers.join(newest, "identifier", "left")


def resolve(identifiers: DataFrame, docs: DataFrame) -> DataFrame:
    """lookup that fails the job on a miss."""
    found = lookup(identifiers, docs)
    ok = F.assert_true(F.col("doc_id").isNotNull(), F.concat(F.lit("unknown document: "), F.col("identifier")))
    return found.where(ok.isNull())


def facet_values(docs: DataFrame) -> DataFrame:
    """(facet, value): distinct non-empty values of areas, regions and source types."""
    rows = docs.select(F.explode(F.concat(F.transform("policy_areas", lambda v: F.struct(F.lit("policy_area").alias("facet"), v.alias("value"))), F.array(F.struct(F.lit("region").alias("facet"), F.col("country_region").alias("value")), F.struct(F.lit("source_type").alias("facet"), F.col("source_type").alias("value"))))).alias("f"))
    return rows.select("f.*").where("value is not null and value <> ''").distinct()


def fingerprint(rows: DataFrame, scope: str, changed: str) -> DataFrame:
    return rows.groupBy(scope).agg(F.count("*").alias("n"), F.max(changed).alias("changed"))


def tree(rows: DataFrame) -> DataFrame:
    """(parent, parent_order, children) of taxonomy rows(parent, child, parent_order, child_order)."""
    kids = F.transform(F.array_sort(F.collect_list(F.struct("child_order", "child"))), lambda x: x["child"])
    return rows.groupBy("parent").agg(F.min("parent_order").alias("parent_order"), kids.alias("children"))


def next_uid(users: DataFrame) -> DataFrame:
    """The highest all-digit uid plus one, five digits at least."""
    numeric = users.where(F.col("uid").rlike("^[0-9]{1,18}$"))
    n = F.coalesce(F.max(F.col("uid").cast("long")), F.lit(0)) + 1
    return numeric.agg(n.alias("n")).select(F.when(F.length(F.col("n").cast("string")) >= 5, F.col("n").cast("string")).otherwise(F.lpad(F.col("n").cast("string"), 5, "0")).alias("uid"))


def distinct_in_order(values: DataFrame, by: str, value: str, position: str) -> DataFrame:
    """The first of values equal but for case and outer spaces, within `by`; blanks go."""
    clean = values.withColumn(value, F.trim(value)).where(F.length(value) > 0)
    w = W.partitionBy(by, F.lower(value)).orderBy(position)
    return clean.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_per_group(rows: DataFrame, by, order, k: int, rank: str = "rank") -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
