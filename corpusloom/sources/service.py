"""Connectors to a service that answers page by page: pacing and retries, pages without repetitions, a capped search cut into
ranges, and a Spark data source that reads the pages of many queries in its tasks.

The transport is a function, so tests drive a made-up service; nothing here opens a connection by itself.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Answers after which the same request is made again.
AGAIN = (408, 429, 500, 502, 503, 504)
PAGE, MOST_PAGES = 100, 10


class Unavailable(Exception):
    """No complete answer after all tries."""


@dataclass
class Paced:
    """Calls ``transport`` (request -> (status, body)) no more often than once in ``gap`` seconds, again after AGAIN and after
    answers that say they aren't complete, waiting twice as long each time."""

    transport: Callable[[dict], tuple[int, dict]]
    gap: float = 1.0
    tries: int = 5
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    last: float = field(default=float("-inf"))

    def ask(self, request: dict) -> dict:
        wait = self.gap
        for _ in range(self.tries):
            self.sleep(max(0.0, self.last + self.gap - self.clock()))
            self.last = self.clock()
            status, body = self.transport(request)
            if status not in AGAIN and not body.get("incomplete_results"):
                if status >= 400:
                    raise Unavailable(f"status {status}")
                return body
            self.sleep(wait)
            wait *= 2
        raise Unavailable(f"status {status} after {self.tries} tries")


def pages(fetch: Callable[[int], list[dict]], keys: tuple[str, ...]) -> Iterator[dict]:
    """Items of consecutive pages up to MOST_PAGES, the first of those with equal keys; a short page is the last."""
    seen = set()
    for page in range(1, MOST_PAGES + 1):
        items = fetch(page)
        for item in items:
            if (mark := tuple(item[k] for k in keys)) not in seen:
                seen.add(mark)
                yield item
        if len(items) < PAGE:
            return


class PagedSource(DataSource):
    """Rows of a paged service: format("paged") with options ``transport`` (module:function, called in the tasks), ``queries``
    (one a line) and ``schema``. A task reads the pages of a query; null where an item lacks a column."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options, [f.name for f in schema])


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = dict(options), columns

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in self.options["queries"].split("\n") if q]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, function = self.options["transport"].partition(":")
        service = Paced(getattr(importlib.import_module(module), function), float(self.options.get("gap", 0)))
        fetch = lambda page: service.ask({"q": partition.value, "page": page, "per_page": PAGE})["items"]
        for item in pages(fetch, tuple(self.options.get("keys", self.columns[0]).split(","))):
            yield tuple(item.get(c) for c in self.columns)
