"""A paged API as a Spark data source: one partition per page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = 100


class Page(InputPartition):
    def __init__(self, start: int, size: int) -> None:
        self.start, self.size = start, size


def register(spark: SparkSession, name: str, schema: str, count: Callable[[], int], fetch: Callable[[int, int], list[tuple]], page: int = PAGE) -> None:
    """Make spark.read.format(name) read an API: count() gives its items, fetch(start, size) a page of rows.

    fetch runs in executors, one task a page, so a lost task asks for its page again.
    """

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [Page(i, page) for i in range(0, count(), page)] or [Page(0, 0)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from fetch(partition.start, partition.size) if partition.size else []

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Source)
