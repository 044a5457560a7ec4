"""Recorded web search: what a search service answered is kept as JSON by query, and later searches read that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.catalogue import top_per_group

#: An item as a service returns it; position is its place in the answer.
ITEM = "query string, position int, url string, title string, markdown string, description string, metadata map<string,string>"
BUCKETS, LIMIT = 64, 5


def _bucket(query: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(query), F.lit(n)).cast("int")


def _first(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def results(items: DataFrame) -> DataFrame:
    """items with the fields of a result: url, title, content, published_at. A page's own metadata beats what the service says of it, and its text any description."""
    of = lambda name: F.try_element_at("metadata", F.lit(name))
    url = F.coalesce(_first(of("source_url"), F.col("url"), of("url")), F.lit(""))
    content = F.coalesce(_first(F.col("markdown"), of("description"), F.col("description")), F.lit(""))
    kept = [c for c in items.columns if c not in ("url", "title", "markdown", "description", "content", "published_at")]
    return items.select(*kept, url.alias("url"), F.coalesce(_first(of("title"), F.col("title")), url).alias("title"), content.alias("content"), of("published_time").alias("published_at"))


def record(items: DataFrame, path: str, n_buckets: int = BUCKETS) -> None:
    """Add items, columns of ITEM, to the recording at path, a directory for each bucket of queries."""
    items.withColumn("bucket", _bucket(F.col("query"), n_buckets)).repartition("bucket").write.partitionBy("bucket").mode("append").json(path)


def search(spark: SparkSession, path: str, queries: DataFrame, limit: int = LIMIT, n_buckets: int = BUCKETS) -> DataFrame:
    """(query_id, query, rank, url, title, content, published_at): the first `limit` recorded results of each of queries(query_id, query).

    Only the directories of the queries' buckets are read. A query that was never recorded has no results.
    """
    asked = queries.select("query_id", "query").where("query is not null")
    buckets = [r[0] for r in asked.select(_bucket(F.col("query"), n_buckets)).distinct().collect()]
    items = spark.read.schema(f"{ITEM}, bucket int").json(path).where(F.col("bucket").isin(buckets))
    first = top_per_group(asked.join(items, "query"), ["query_id"], ["position", "url"], limit)
    return results(first).select("query_id", "query", "rank", "url", "title", "content", "published_at")


def fetched(spark: SparkSession, path: str, urls: DataFrame) -> DataFrame:
    """(url, title, content, published_at) of urls(url) as first recorded; a url that no result has is left out."""
    rows = results(spark.read.schema(ITEM).json(path)).join(urls.select("url").distinct(), "url", "left_semi")
    best = rows.groupBy("url").agg(F.min_by(F.struct("title", "content", "published_at"), F.struct("position", "query")).alias("b"))
    return best.select("url", "b.*")
