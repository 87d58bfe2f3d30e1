"""A source of numbered pages, as a polled API leaves them: one partition per page, and a stream by page.

A page is a folder ``page=N`` whose files hold a JSON object per line; it may hold none. Pages count from one; the
source reads up to the first missing one, and never beyond ``max_pages``.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType, TimestampType

from findweave.sources import exclusive


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


def _last_page(path: str, cap: int | None) -> int:
    there = {f.base_name for f in exclusive.listed(path)}
    number = 0
    while f"page={number + 1}" in there and (cap is None or number < cap):
        number += 1
    return number


def _rows(path: str, number: int, schema: StructType) -> Iterator[tuple]:
    for file in exclusive.listed(f"{path}/page={number}"):
        for line in exclusive.content(f"{path}/page={number}/{file.base_name}").splitlines():
            if not line:
                continue  # a page without items
            item = json.loads(line)
            yield tuple(datetime.datetime.fromisoformat(v) if isinstance(f.dataType, TimestampType) and v is not None else v for f in schema for v in [item.get(f.name)])


class _Pages:
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.cap = int(options["max_pages"]) if "max_pages" in options else None

    def read(self, partition: Page | None) -> Iterator[tuple]:
        return iter(()) if partition is None else _rows(self.path, partition.value, self.schema)  # None: there are no pages


class PageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return [Page(n) for n in range(1, _last_page(self.path, self.cap) + 1)]


class PageStream(_Pages, DataSourceStreamReader):
    """Offsets are page numbers, so a restarted query goes on after the last page that it committed."""

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": _last_page(self.path, self.cap)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(n) for n in range(start["page"] + 1, end["page"] + 1)]

    def commit(self, end: dict) -> None:
        """Pages stay where they are."""


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "findweave_pages"

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(schema, self.options)

    def streamReader(self, schema: StructType) -> PageStream:
        return PageStream(schema, self.options)


def read_paged(spark: SparkSession, path: str, schema: str, max_pages: int | None = None, stream: bool = False) -> DataFrame:
    """Rows of the pages under ``path``, as a table or as a stream."""
    spark.dataSource.register(PagedSource)
    reader = (spark.readStream if stream else spark.read).format(PagedSource.name()).schema(schema).option("path", path)
    return (reader if max_pages is None else reader.option("max_pages", str(max_pages))).load()


def write_pages(items: DataFrame, path: str, page: str, from_page: int = 1) -> None:
    """Write (page number, item columns) as pages; one file per page."""
    line = F.to_json(F.struct(*[c for c in items.columns if c != page]), {"ignoreNullFields": "false"})
    items.where(F.col(page) >= from_page).select(F.col(page).alias("page"), line.alias("value")).repartition("page").write.mode("append").partitionBy("page").text(path)
