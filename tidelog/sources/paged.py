"""A cursor-paged service as a Spark data source, batch and stream.

The service is a folder of page files here (page-000.json, page-001.json, ...), each with
``items`` and ``next``; a real service subclasses ``fetch``.  A stream's offset is the number
of pages read, so a restart goes on where the checkpoint stands.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class Pages:
    """The service's pages; shared by both readers."""

    def __init__(self, options: dict):
        self.folder = options["path"]

    def fetch(self, number: int) -> dict | None:
        name = os.path.join(self.folder, f"page-{number:03d}.json")
        if not os.path.exists(name):
            return None
        with open(name, encoding="utf-8") as f:
            return json.load(f)

    def count(self) -> int:
        n = 0
        while self.fetch(n) is not None:
            n += 1
        return n

    def rows(self, number: int) -> Iterator[tuple]:
        page = self.fetch(number)
        for item in page["items"] if page else ():
            yield item.get("id"), item.get("title"), item.get("text"), item.get("updated_at")


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages = Pages(options)

    def partitions(self) -> list[Page]:
        return [Page(k) for k in range(self.pages.count())]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.pages.rows(partition.number)


class PagedStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pages = Pages(options)

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": self.pages.count()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(k) for k in range(start["page"], end["page"])]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.pages.rows(partition.number)

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelog-paged"

    def schema(self) -> str:
        return "id string, title string, text string, updated_at string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStream(self.options)


def read_paged(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("tidelog-paged").load(folder)


def latest_by_remote(rows: DataFrame) -> DataFrame:
    """Of items that pages repeat, the newest state of each."""
    newest = F.max_by(F.struct("title", "text", "updated_at"), "updated_at").alias("s")
    return rows.groupBy("id").agg(newest).select("id", "s.*")
