"""Okapi BM25 over a corpus for a table of queries, set-based.

The corpus is read once and its tokens meet the query vocabulary before any shuffle. Postings are dealt out by document; statistics and queries are sent to them where they
are small, so the rows of query, document and term never leave their tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.functions.text import keyword_tokens
from lodestack.storage import keep, small

K1, B = 1.5, 0.75
#: A vocabulary, or statistics or questions by term, are sent to every task up to so many rows (some 20 MB); beyond, they're joined by shuffles.
SENT_ROWS = 500_000
#: So many pairs of query and document are added up and ranked in one task, however many there are in all.
PAIRS_PER_TASK = 2_000_000


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term), distinct, of queries(query_id, text)."""
    return queries.select("query_id", F.explode(F.array_distinct(keyword_tokens(F.col("text")))).alias("term"))


def postings(corpus: DataFrame, vocabulary: DataFrame, sent_rows: int = SENT_ROWS) -> DataFrame:
    """(scope, doc_id, dl, term, tf) of corpus(scope, doc_id, text) for the terms of vocabulary(term), and a row of null term for each document.

    A vocabulary of up to sent_rows terms is sent to the tasks that read the corpus, and tokens outside it go no further. For a larger one the documents' distinct
    terms are shuffled, and the documents' own rows, whose term is null, aren't part of that join.
    """
    known = keep(vocabulary.select("term").distinct(), "bm25-vocabulary")
    tokens = corpus.select("scope", "doc_id", keyword_tokens(F.col("text")).alias("tokens"))
    rows = tokens.select("scope", "doc_id", F.size("tokens").alias("dl"), F.explode(F.concat("tokens", F.array(F.lit(None).cast("string")))).alias("term"))
    by = ["scope", "doc_id", "dl", "term"]
    sent, fits = small(known, sent_rows)
    if fits:
        return rows.join(sent.withColumn("known", F.lit(True)), "term", "left").where("known or term is null").groupBy(*by).agg(F.count("*").alias("tf"))
    bags = keep(rows.groupBy(*by).agg(F.count("*").alias("tf")), "bm25-bags")
    return bags.where("term is not null").join(known, "term").select(*by, "tf").unionByName(bags.where("term is null"))


def term_frequencies(corpus: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return postings(corpus, vocabulary).where("term is not null")


def idf(n_docs: Column, df: Column) -> Column:
    return F.ln(1.0 + (n_docs - df + 0.5) / (df + 0.5))


def weight(idf_: Column, tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def summed(tf: DataFrame, terms: DataFrame, by: list[str], k1: float = K1, b: float = B, sent_rows: int = SENT_ROWS) -> DataFrame:
    """(by, query_id, doc_id, bm25_score), positive only: tf(by, doc_id, dl, term, tf) weighed by terms(by, query_id, term, df, idf, avgdl).

    Rows are dealt out by document first. What a query and a document have in common is then added up where it is, if terms can be sent there. df says how many rows
    of query, document and term there will be, and so into how many tasks they go: the memory of a task doesn't grow with the corpus.
    """
    weights = keep(terms, "bm25-weights")
    sent, fits = small(weights, sent_rows)
    pairs = weights.agg(F.sum("df")).first()[0] or 0
    n = max(-(-pairs // PAIRS_PER_TASK), tf.sparkSession.sparkContext.defaultParallelism)
    rows = tf.repartition(n, "doc_id").join(sent, [*by, "term"]) if fits else tf.join(sent, [*by, "term"]).repartition(n, "doc_id")
    weighed = rows.withColumn("weight", weight(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b))
    return weighed.groupBy(*by, "query_id", "doc_id").agg(F.sum("weight").alias("bm25_score")).where("bm25_score > 0")


def statistics(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scope, n_docs, avgdl) and (scope, term, df) of postings, nulls included."""
    stats = found.where("term is null").groupBy("scope").agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avgdl"))
    return stats, found.where("term is not null").groupBy("scope", "term").agg(F.count("*").alias("df"))


def scores(corpus: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, sent_rows: int = SENT_ROWS) -> DataFrame:
    """(scope, query_id, doc_id, bm25_score), positive only, of corpus(scope, doc_id, text) and queries(query_id, text).

    Statistics are those of the scope; documents without tokens count. Distinct query terms count once. Null texts count as empty.
    """
    terms = keep(query_terms(queries), "bm25-terms")
    return scores_of(keep(postings(corpus, terms, sent_rows), "bm25-postings"), terms, k1, b, sent_rows)


def scores_of(found: DataFrame, terms: DataFrame, k1: float = K1, b: float = B, sent_rows: int = SENT_ROWS) -> DataFrame:
    """scores from postings, nulls included, and query_terms; both are written tables."""
    stats, df = statistics(found)
    weights = df.join(stats, "scope").join(terms, "term").select("scope", "query_id", "term", "df", idf(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl")
    return summed(found.where("term is not null"), weights, ["scope"], k1, b, sent_rows)


def top(scored: DataFrame, k: int, score: str = "bm25_score", by=("query_id", "scope")) -> DataFrame:
    """The k best of each query with rank; equal scores, to 9 decimals, by doc_id."""
    order = W.partitionBy(*by).orderBy(F.round(score, 9).desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
