"""A board's list and detail pages as a Spark data source, over a pluggable client so that nothing here needs a network."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_CLIENTS: dict[str, Callable[[str], Callable[[int], str]]] = {}


def register_client(name: str, make: Callable[[str], Callable[[int], str]]) -> None:
    """make(board) returns a function from a page number to that page's HTML."""
    _CLIENTS[name] = make


def polite(fetch: Callable[[int], str], least: float = 1.0, most: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[int], str]:
    """Waits a random time before every request but the first."""
    asked = False

    def get(page: int) -> str:
        nonlocal asked
        if asked:
            sleep(random.uniform(least, most))
        asked = True
        return fetch(page)

    return get


class BoardSource(DataSource):
    """spark.read.format("board").option("client", ...).option("board", ...).option("pages", n).load(): page, html."""

    @classmethod
    def name(cls) -> str:
        return "board"

    def schema(self) -> str:
        return "page int, html string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, _CLIENTS[self.options["client"]](self.options["board"]))


class _Reader(DataSourceReader):
    def __init__(self, options, fetch) -> None:
        self.pages, self.per_task, self.fetch = int(options.get("pages", "1")), int(options.get("pages_per_task", "50")), fetch

    def partitions(self):
        return [InputPartition((i, min(i + self.per_task - 1, self.pages))) for i in range(1, self.pages + 1, self.per_task)]

    def read(self, partition):
        first, last = partition.value
        fetch = polite(self.fetch)
        for page in range(first, last + 1):
            yield page, fetch(page)
