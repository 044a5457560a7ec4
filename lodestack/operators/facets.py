"""A facet index: which documents have which value of which dimension, and searches that start from a filter's rarest part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.storage import keep, small

#: Dimensions of filters, and the document columns that they look at. One value of a dimension is enough, but a document needs all tags.
DIMENSIONS = {"policy_areas": "policy_areas", "country_regions": "country_region", "source_organisations": "source_organisation", "languages": "language", "tags": "keywords"}
ALL_NEEDED = "tags"
YEARS = "years"
#: Filters are sent to every task up to so many rows; beyond, they're joined by shuffles.
SENT_ROWS = 20_000


def _lower(values: Column) -> Column:
    return F.transform(values, lambda v: F.lower(v))


def _pairs(dimension: str, values: Column) -> Column:
    pairs = F.transform(values, lambda v: F.struct(F.lit(dimension).alias("dimension"), F.lower(v).alias("value")))
    return F.coalesce(pairs, F.array().cast("array<struct<dimension:string,value:string>>"))


def _parts(dimension: str, values: Column) -> Column:
    part = lambda v: F.concat(F.lit(dimension + ":"), v) if dimension == ALL_NEEDED else F.lit(dimension)
    return F.transform(F.array_distinct(_lower(values)), lambda v: F.struct(part(v).alias("part"), F.lit(dimension).alias("dimension"), v.alias("value")))


class FacetIndex:
    """docs(doc_id, policy_areas, country_region, source_organisation, language, keywords, year) by their values, in any case.

    postings(dimension, value, doc_id) and the documents' own facets are written once, without texts; counts(dimension, value, n) is as small as the
    catalogue's vocabulary. Nulls are no values.
    """

    def __init__(self, docs: DataFrame):
        lists = [c for c in DIMENSIONS.values() if docs.schema[c].dataType.typeName() == "array"]
        self.docs = keep(docs.select("doc_id", *DIMENSIONS.values(), "year"), "facet-docs")
        pairs = [_pairs(d, F.col(c) if c in lists else F.array(c)) for d, c in DIMENSIONS.items()] + [_pairs(YEARS, F.array(F.col("year").cast("string")))]
        rows = self.docs.select("doc_id", F.explode(F.array_distinct(F.concat(*pairs))).alias("p"))
        self.postings = keep(rows.select("p.dimension", "p.value", "doc_id").where("value is not null"), "facet-postings")
        self.counts = keep(self.postings.groupBy("dimension", "value").agg(F.count("*").alias("n")), "facet-counts")
        bounds = self.counts.where(F.col("dimension") == YEARS).agg(F.min(F.col("value").cast("int")).alias("first"), F.max(F.col("value").cast("int")).alias("last")).first()
        # without any year, a span that holds none
        self.first_year, self.last_year = (bounds["first"], bounds["last"]) if bounds["first"] is not None else (1, 0)


def wanted(filters: DataFrame, index: FacetIndex) -> DataFrame:
    """(query_id, part, dimension, value): what filters ask for, in lower case. Each part has to be met by one of its values.

    A dimension is a part, each tag is one. Years are one only where nothing else is asked for, and are then
    listed one by one within those that the index has; otherwise they are looked at last.
    """
    arrays = [_parts(d, F.col(d)) for d in DIMENSIONS]
    none = reduce(lambda a, b: a & b, [F.size(d) == 0 for d in DIMENSIONS])
    first = F.greatest(F.coalesce("year_from", F.lit(index.first_year)), F.lit(index.first_year))
    last = F.least(F.coalesce("year_to", F.lit(index.last_year)), F.lit(index.last_year))
    dated = none & (F.col("year_from").isNotNull() | F.col("year_to").isNotNull()) & (first <= last)
    # sequence is evaluated on any row, so its ends are put in order
    years = _parts(YEARS, F.sequence(F.least(first, last), F.greatest(first, last)).cast("array<string>"))
    parts = F.concat(*arrays, F.when(dated, years).otherwise(F.array().cast("array<struct<part:string,dimension:string,value:string>>")))
    return filters.select("query_id", F.explode(parts).alias("p")).select("query_id", "p.*")


def matches() -> Column:
    """Whether a document, as d, meets filters, as f: any value within a dimension, all tags, years inclusive; a missing year meets no bound."""
    none = lambda d: F.size(f"f.{d}") == 0
    same = lambda d, c: none(d) | F.coalesce(F.array_contains(_lower(F.col(f"f.{d}")), F.lower(f"d.{c}")), F.lit(False))
    areas = none("policy_areas") | F.coalesce(F.arrays_overlap(_lower(F.col("f.policy_areas")), _lower(F.col("d.policy_areas"))), F.lit(False))
    tags = F.size(F.array_except(_lower(F.col("f.tags")), F.coalesce(_lower(F.col("d.keywords")), F.array().cast("array<string>")))) == 0
    from_ok = F.col("f.year_from").isNull() | F.coalesce(F.col("d.year") >= F.col("f.year_from"), F.lit(False))
    to_ok = F.col("f.year_to").isNull() | F.coalesce(F.col("d.year") <= F.col("f.year_to"), F.lit(False))
    return areas & same("country_regions", "country_region") & same("source_organisations", "source_organisation") & same("languages", "language") & tags & from_ok & to_ok


def hits(filters: DataFrame, index: FacetIndex) -> DataFrame:
    """(query_id, doc_id) of the documents that meet filters(query_id, the five lists, year_from, year_to), each once; filters that ask for nothing have none.

    Every document that meets filters meets their rarest part. So only that part's postings are fetched, by an equi-join, and the rest is
    tested on the documents found: work follows the rarest part of each filter.
    """
    parts = keep(wanted(filters, index), "facet-wanted")
    costs = parts.join(index.counts, ["dimension", "value"], "left").groupBy("query_id", "part").agg(F.sum(F.coalesce("n", F.lit(0))).alias("cost"))
    rarest = costs.groupBy("query_id").agg(F.min_by("part", F.struct("cost", "part")).alias("part"))
    # the filters go to the documents, not the other way: few rows of filters would be few tasks, in which all that they find is joined
    sent, _ = small(keep(parts.join(rarest, ["query_id", "part"]), "facet-rarest"), SENT_ROWS)
    asked, _ = small(keep(filters, "facet-filters"), SENT_ROWS)
    found = index.postings.join(sent, ["dimension", "value"]).select("query_id", "doc_id").distinct()
    return found.join(index.docs, "doc_id").alias("d").join(asked.alias("f"), F.col("d.query_id") == F.col("f.query_id")).where(matches()).select("f.query_id", "d.doc_id")
