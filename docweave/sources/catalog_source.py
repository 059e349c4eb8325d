"""Paginated catalogue as a Spark data source, and the download sink.

The transport is given by name: `fixture` reads pages of a JSON file, so everything runs without a network; a service
transport needs only fetch_page(category, page, name). One input partition is one page of one category; an equality
filter on the name is pushed to the transport. Spark keeps a pushed filter with the loaded relation: load again for
another filter.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

SCHEMA = "category string, name string, goods_code string, sale_date string, document_id string, status string"
COLUMNS = ("category", "name", "goods_code", "sale_date", "document_id", "status")


class FixturePages:
    """Rows of a JSON list of objects, served page by page."""

    def __init__(self, path: str, page_size: int):
        self.rows, self.page_size = json.loads(Path(path).read_text()), page_size

    def _of(self, category: str, name: str | None) -> list[dict]:
        return [r for r in self.rows if r.get("category") == category and (name is None or r.get("name") == name)]

    def categories(self) -> list[str]:
        return sorted({r["category"] for r in self.rows if r.get("category")})

    def total(self, category: str, name: str | None) -> int:
        return len(self._of(category, name))

    def fetch_page(self, category: str, page: int, name: str | None) -> list[dict]:
        return self._of(category, name)[(page - 1) * self.page_size : page * self.page_size]


def with_retries(call: Callable, attempts: int = 3, pause: float = 0.0):
    """The call's result; connection errors are tried again after pauses that grow linearly."""
    for k in range(1, attempts + 1):
        try:
            return call()
        except (ConnectionError, TimeoutError):
            if k == attempts:
                raise
            time.sleep(pause * k)


@dataclass
class Page(InputPartition):
    category: str
    number: int


class CatalogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.page_size, self.name = options["path"], int(options.get("pagesize", 100)), None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.name = f.value
            else:
                yield f

    def partitions(self) -> list[Page]:
        pages = FixturePages(self.path, self.page_size)
        return [Page(c, k) for c in pages.categories() for k in range(1, -(-pages.total(c, self.name) // self.page_size) + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        pages = FixturePages(self.path, self.page_size)
        for r in with_retries(lambda: pages.fetch_page(partition.category, partition.number, self.name)):
            yield tuple(r.get(c) for c in COLUMNS)


class CatalogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "term_catalog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CatalogReader:
        return CatalogReader(self.options)


def register(spark) -> None:
    """Make the source known to the session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CatalogSource)


def store_download(content: bytes, target: Path) -> tuple[int, str]:
    """(size, sha256) of a PDF put in place in one step; anything that is no PDF raises and leaves nothing behind."""
    import hashlib

    if not content.startswith(b"%PDF-"):
        raise ValueError("the content is no PDF")
    part = target.with_suffix(target.suffix + ".part")
    part.write_bytes(content)
    part.replace(target)
    return len(content), hashlib.sha256(content).hexdigest()
