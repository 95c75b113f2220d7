"""A paged source as a Spark data source: pages are partitions, and a sample is a choice of pages.

``spark.read.format("paged").option("fetch", "module:function")`` calls
function(split, offset, length) -> {"rows": [{"row": {...}}], "num_rows_total": n}
on the workers; without it, option("url") names an endpoint that gives the same
JSON for offset and length. Rows come as JSON text with their ordinal.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PAGE = 100


def with_retries(call: Callable[[], dict], tries: int = 4, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """call(), again after wait, 2 wait, ... seconds; the last error is raised."""
    for k in range(1, tries + 1):
        try:
            return call()
        except (OSError, ValueError):
            if k == tries:
                raise
            sleep(wait * k)
    raise AssertionError


def fetch_url(url: str, split: str, offset: int, length: int) -> dict:
    from urllib.parse import urlencode
    from urllib.request import urlopen

    with urlopen(f"{url}{'&' if '?' in url else '?'}{urlencode({'split': split, 'offset': offset, 'length': length})}", timeout=30) as f:
        return json.load(f)


def page_offsets(total: int, page: int = PAGE, pages: int | None = None) -> list[int]:
    """All offsets, or those of a systematic sample: every max(page, total // pages) rows."""
    step = page if pages is None else max(page, total // pages)
    return list(range(0, total, step))


class Page(InputPartition):
    def __init__(self, split: str, offset: int, ordinal: int):
        self.split, self.offset, self.ordinal = split, offset, ordinal


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.splits = options.get("splits", "train").split(",")
        self.page = int(options.get("page", PAGE))
        self.sample = int(options["samplepages"]) if "samplepages" in options else None
        self.skip_failed = options.get("skipfailed", "false").lower() == "true"
        self.wait, self.tries = float(options.get("wait", 2)), int(options.get("tries", 4))

    def fetch(self, split: str, offset: int, length: int) -> dict:
        if name := self.options.get("fetch"):
            module, _, function = name.partition(":")
            call = getattr(importlib.import_module(module), function)
        else:
            call = lambda *a: fetch_url(self.options["url"], *a)
        return with_retries(lambda: call(split, offset, length), self.tries, self.wait)

    def partitions(self) -> list[Page]:
        out: list[Page] = []
        for split in self.splits:
            total = int(self.fetch(split, 0, 1).get("num_rows_total", 0))
            out += [Page(split, at, len(out) + k) for k, at in enumerate(page_offsets(total, self.page, self.sample))]
        return out

    def read(self, partition: Page) -> Iterator[tuple]:
        try:
            rows = self.fetch(partition.split, partition.offset, self.page).get("rows", [])
        except (OSError, ValueError):
            if not self.skip_failed:
                raise
            return
        for k, r in enumerate(rows):
            yield partition.split, partition.ordinal * self.page + k, json.dumps(r["row"], ensure_ascii=False)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "split string, ordinal bigint, row string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(dict(self.options))
