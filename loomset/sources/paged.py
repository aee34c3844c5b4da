"""A paged record service as a Spark data source.

Readers take one page after the other: a page begins after the key that the last one ended with, and a short page is the last. How a
page is fetched is a function of the service's own client, given by name; file_pages serves pages from JSON lines, which
is what tests use, as there is no network.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MOST_A_PAGE, MOST_RECORDS = 100, 100_000


def file_pages(options: dict[str, str], part: str, after: str | None, size: int) -> list[dict]:
    """Up to size records of a JSON lines file whose key comes after a given one. part: the file."""
    key = options["key"]
    with open(part) as f:
        found = sorted((r for r in map(json.loads, filter(str.strip, f)) if after is None or str(r[key]) > after), key=lambda r: str(r[key]))
    return found[:size]


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.options["parts"].split(",") if p]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.options.get("pages", "loomset.sources.paged:file_pages").partition(":")
        fetch = getattr(importlib.import_module(module), name)
        size = min(int(self.options.get("page_size", MOST_A_PAGE)), MOST_A_PAGE)
        left = min(int(self.options.get("limit", MOST_RECORDS)), MOST_RECORDS)
        after = None
        while left > 0:
            page = fetch(self.options, partition.value, after, min(size, left))
            for record in page:
                yield tuple(record.get(f.name) for f in self.schema)
            left -= len(page)
            if len(page) < size:
                return
            after = str(page[-1][self.options["key"]])


class PagedRecords(DataSource):
    """spark.read.format('paged_records').schema(...).option('key', ...).option('parts', 'a,b').load(); each part is a task."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        raise ValueError("paged_records needs a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))
