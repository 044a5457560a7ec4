"""Web search results and fetched pages as a data source over pluggable providers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "query string, url string, title string, content string, published_at string, metadata map<string,string>"


class Provider:
    """search(query, limit) yields dicts with url, title, content, published_at, metadata."""

    def search(self, query: str, limit: int) -> list[dict]:
        raise NotImplementedError(f"{type(self).__name__} can't search")


class Unavailable(Provider):
    """A provider that is named but not built."""


PROVIDERS: dict[str, type[Provider]] = {"unavailable": Unavailable}


def provider(name: str) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"unknown web search provider {name}")
    return PROVIDERS[name]()


class Query(InputPartition):
    def __init__(self, text: str):
        self.text = text


class WebSearch(DataSource):
    """spark.read.format("web_search").option("provider", ...).option("queries", "a\\nb").option("limit", 5)"""

    @classmethod
    def name(cls) -> str:
        return "web_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WebSearchReader(self.options)


class WebSearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.queries = [q for q in options.get("queries", "").split("\n") if q.strip()]
        self.limit, self.source = int(options.get("limit", 5)), provider(options["provider"])

    def partitions(self) -> list[InputPartition]:
        return [Query(q) for q in self.queries]

    def read(self, partition: Query) -> Iterator[tuple]:
        for r in self.source.search(partition.text, self.limit)[: self.limit]:
            yield partition.text, r["url"], r.get("title", ""), r.get("content", ""), r.get("published_at"), r.get("metadata") or {}
