"""Scopes of questions as bitmaps, and keyword search with each scope's own statistics.

Questions whose filters are the same share a scope. A scope is a bitmap of document ids, 32,768 to a row, so how many documents it has, how long they
are together and whether one is in it are questions to bitmaps; no row of question and document is written for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators import bm25, facets
from lodestack.storage import keep

#: The scope of questions whose filters leave nothing, or that have none.
ALL = "*"
#: A document's length is summed by its bits, of which it has so many at most; -1 is the plane of all documents.
LENGTH_BITS = 31
#: Documents of a bitmap; bits are looked up in pieces of it, for so many documents each.
BUCKET, PIECE = 32_768, 1024


def bitmaps(rows: DataFrame, *by: str) -> DataFrame:
    """(by, bucket, bits) of rows(by, doc_id)."""
    return rows.groupBy(*by, F.bitmap_bucket_number("doc_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("bits"))


def pieces(bits: DataFrame) -> DataFrame:
    """bits(..., bucket, bits) cut into pieces of PIECE documents, those without any left out: a row that looks into a bitmap copies it, 4,096 bytes if it is whole."""
    cut = bits.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(BUCKET // PIECE - 1))))
    return cut.withColumn("bits", F.substr("bits", F.col("piece") * (PIECE // 8) + 1, F.lit(PIECE // 8))).where(F.bitmap_count("bits") > 0)


def piece_of(doc_id: Column) -> Column:
    """The piece, within its bucket, that a document's bit is in."""
    return F.floor(F.bitmap_bit_position(doc_id) / PIECE).cast("int")


def has(bits: Column, doc_id: Column, size: int = BUCKET) -> Column:
    """Whether a bitmap of the document's bucket, or its piece of so many documents, has the document."""
    at = F.bitmap_bit_position(doc_id) % size
    byte = F.conv(F.hex(F.substr(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int").bitwiseAND(F.lit(1)) == 1


class Scopes:
    """What filters(query_id, ...) leave of a facet index: of_query(query_id, scope), members(scope, doc_id) of the filtered scopes, bits(scope, bucket, bits) of all scopes in use."""

    def __init__(self, filters: DataFrame, index: facets.FacetIndex):
        same = F.sha2(F.to_json(F.struct(*[F.array_sort(F.transform(F.col(d), lambda v: F.lower(v))).alias(d) for d in facets.DIMENSIONS], F.coalesce("year_from", F.lit(0)).alias("a"), F.coalesce("year_to", F.lit(0)).alias("b"))), 256)
        named = keep(filters.withColumn("scope", same), "scope-filters")
        once = named.drop("query_id").dropDuplicates(["scope"]).withColumnRenamed("scope", "query_id")
        self.members = keep(facets.hits(once, index).select(F.col("query_id").alias("scope"), "doc_id"), "scope-members")
        filtered = keep(bitmaps(self.members, "scope"), "scope-bits")
        known = filtered.select("scope").distinct().withColumn("found", F.lit(True))
        self.of_query = keep(named.join(known, "scope", "left").select("query_id", F.when(F.col("found"), F.col("scope")).otherwise(F.lit(ALL)).alias("scope")), "scope-of-query")
        everything = bitmaps(index.docs.select(F.lit(ALL).alias("scope"), "doc_id"), "scope")
        self.bits = keep(filtered.unionByName(everything), "scope-bits")
        self.docs = index.docs

    def rows(self, docs: DataFrame) -> DataFrame:
        """docs(doc_id, ...) once for each scope in use that has them, with scope."""
        used = self.of_query.where(F.col("scope") == ALL).limit(1).withColumnRenamed("scope", "used").select("used")
        whole = docs.join(self.docs.select("doc_id"), "doc_id", "left_semi").withColumn("scope", F.lit(ALL))
        # all documents only where some question needs them
        whole = whole.join(used, whole["scope"] == used["used"], "left_semi")
        return docs.join(self.members, "doc_id").unionByName(whole, allowMissingColumns=True)


def statistics(docs: DataFrame, bits: DataFrame) -> DataFrame:
    """(scope, n_docs, avgdl) for docs(doc_id, dl) within scopes bits(scope, bucket, bits): lengths are added up plane by plane of their bits."""
    planes = F.concat(F.array(F.lit(-1)), F.filter(F.sequence(F.lit(0), F.lit(LENGTH_BITS - 1)), lambda i: F.floor(F.col("dl") / F.pow(F.lit(2), i)) % 2 == 1))
    of_plane = bitmaps(docs.select("doc_id", F.explode(planes).alias("plane")), "plane").withColumnRenamed("bits", "own")
    both = bits.join(of_plane, "bucket").select("scope", "plane", "bucket", F.explode(F.array("bits", "own")).alias("b"))
    met = both.groupBy("scope", "plane", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("b")).alias("n"))
    total = F.sum(F.when(F.col("plane") >= 0, F.col("n") * F.pow(F.lit(2), F.col("plane"))).otherwise(0))
    out = met.groupBy("scope").agg(F.sum(F.when(F.col("plane") < 0, F.col("n"))).alias("n_docs"), total.alias("words"))
    return out.where("n_docs > 0").select("scope", "n_docs", (F.col("words") / F.col("n_docs")).alias("avgdl"))


def scores(found: DataFrame, terms: DataFrame, scopes: Scopes, k1: float = bm25.K1, b: float = bm25.B) -> DataFrame:
    """(query_id, doc_id, bm25_score), positive only: questions' terms(query_id, term) against postings found(doc_id, dl, term, tf), each within its scope.

    found has a row of null term for each document. Number of documents, document frequency and average length are the scope's own.
    """
    # scopes go by numbers here: their names are long, and would go with every posting
    numbers = keep(scopes.of_query.select("scope").distinct().withColumn("number", F.monotonically_increasing_id()), "scope-numbers")
    numbered = lambda df: df.join(numbers, "scope").drop("scope").withColumnRenamed("number", "scope")
    bits = keep(numbered(scopes.bits), "scope-bits")
    stats = statistics(found.where("term is null").select("doc_id", "dl"), bits)
    asked = keep(terms.join(numbered(scopes.of_query), "query_id"), "scope-terms")
    tf = found.where("term is not null").select("doc_id", "dl", "term", "tf")
    within = asked.select("scope", "term").distinct().join(tf, "term").withColumns({"bucket": F.bitmap_bucket_number("doc_id"), "piece": piece_of(F.col("doc_id"))})
    within = keep(within.join(pieces(bits), ["scope", "bucket", "piece"]).where(has(F.col("bits"), F.col("doc_id"), PIECE)).select("scope", "doc_id", "dl", "term", "tf"), "scope-postings")
    df = within.groupBy("scope", "term").agg(F.count("*").alias("df"))
    weights = df.join(stats, "scope").join(asked, ["scope", "term"]).select("scope", "query_id", "term", "df", bm25.idf(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl")
    return bm25.summed(within, weights, ["scope"], k1, b).select("query_id", "doc_id", "bm25_score")
