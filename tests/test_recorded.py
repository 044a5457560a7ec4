"""Recorded web search against plain rules."""

import pytest
from pyspark.sql import functions as F

from lodestack.sources import recorded

ITEMS = [
    ("a", 2, "http://x/2", "Two", "# two", "d", {}),
    ("a", 1, "http://x/1", None, None, "said", {"source_url": "http://y/1", "description": "own", "published_time": "2024"}),
    ("a", 3, None, "", "", "", {"url": "http://z/3", "title": "Own"}),
    ("a", 4, None, None, None, None, None),
    ("b", 1, "http://x/2", "Other", "later", None, {"title": ""}),
    ("法", 1, "u", "t", "m", None, None),
]


@pytest.fixture
def path(spark, tmp_path):
    recorded.record(spark.createDataFrame(ITEMS[:3], recorded.ITEM), f"{tmp_path}/web", 8)
    recorded.record(spark.createDataFrame(ITEMS[3:], recorded.ITEM), f"{tmp_path}/web", 8)
    return f"{tmp_path}/web"


def test_search(spark, path):
    asked = spark.createDataFrame([(1, "a"), (2, "法"), (3, "never"), (4, None), (5, "a")], "query_id long, query string")
    rows = recorded.search(spark, path, asked, 3, 8).collect()
    got = {(r.query_id, r["rank"]): (r.url, r.title, r.content, r.published_at) for r in rows}
    first = {1: ("http://y/1", "http://y/1", "own", "2024"), 2: ("http://x/2", "Two", "# two", None), 3: ("http://z/3", "Own", "", None)}
    assert got == {**{(q, k): v for q in (1, 5) for k, v in first.items()}, (2, 1): ("u", "t", "m", None)}
    whole = recorded.search(spark, path, asked.where("query_id = 1"), n_buckets=8)
    assert whole.count() == 4 and whole.where("rank = 4").first().url == ""


def test_only_the_queries_buckets_are_read(spark, path):
    plan = recorded.search(spark, path, spark.createDataFrame([(1, "b")], "query_id long, query string"), n_buckets=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket#" in plan and "query#" in plan


def test_fetched(spark, path):
    got = {r.url: (r.title, r.content) for r in recorded.fetched(spark, path, spark.createDataFrame([("http://x/2",), ("u",), ("nowhere",), (None,)], "url string")).collect()}
    assert got == {"http://x/2": ("Other", "later"), "u": ("t", "m")}


def test_empty(spark, tmp_path):
    recorded.record(spark.createDataFrame(ITEMS[:1], recorded.ITEM), f"{tmp_path}/one")
    assert recorded.search(spark, f"{tmp_path}/one", spark.createDataFrame([], "query_id long, query string")).collect() == []
    assert recorded.results(spark.createDataFrame([], recorded.ITEM).withColumn("extra", F.lit(1))).columns == ["query", "position", "metadata", "extra", "url", "title", "content", "published_at"]
