"""Paged record searches as a Spark data source; the transport is given, so that tests and sites without a network bring their own."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "species string, latitude double, longitude double, year int, country string, basis string, uncertainty double"
#: Transport by name: (offset, limit) -> (rows, whether that was the last page)
TRANSPORTS: dict[str, Callable[[dict, int, int], tuple[list[tuple], bool]]] = {}


def pages(fetch: Callable, query: dict, limit: int, most: int, tries: int = 6, pause: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """Rows of all pages up to ``most``; a failed request is tried again after 1.8^n seconds."""
    offset = 0
    while offset < most:
        for n in range(tries):
            try:
                rows, last = fetch(query, offset, min(limit, most - offset))
                break
            except OSError:
                if n == tries - 1:
                    raise
                pause(1.8**n)
        yield from rows
        offset += len(rows)
        if last or not rows:
            return


class RecordSearch(DataSource):
    """format("records") with options species (comma list), transport, limit, most: one partition for each species."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(s.strip()) for s in self.options["species"].split(",") if s.strip()]

    def read(self, partition):
        import importlib

        module, _, name = self.options["transport"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        yield from pages(fetch, {"species": partition.value}, int(self.options.get("limit", 300)), int(self.options.get("most", 100_000)))
