"""A meta-search connector as a Python data source. The service is an injected callable; offline it reads a table."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class SearchSource(DataSource):
    """format("millrace_search") with the options `query` and `results`, a JSON list of {title, url, content}.

    A deployment subclasses it and fetches results from its endpoint in `fetch`.
    """

    @classmethod
    def name(cls) -> str:
        return "millrace_search"

    def schema(self) -> str:
        return "title string, url string, content string"

    def fetch(self, query: str) -> list[dict]:
        words = query.lower().split()
        return [r for r in json.loads(self.options.get("results", "[]")) if any(w in (r.get("title") or "").lower() for w in words)]

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(self)


class SearchReader(DataSourceReader):
    def __init__(self, source: SearchSource):
        self.source = source

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        limit = int(self.source.options.get("limit", "10"))
        for r in self.source.fetch(self.source.options.get("query", ""))[:limit]:
            yield r.get("title"), r.get("url"), r.get("content")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SearchSource)
