"""A data source for tables that a service gives out page by page.

Batch: the key's range is cut into partitions, each read by a task of its own, page after page
from the last key on until a page is short.  Stream: an offset is the largest key that has been
read, kept by Spark in the checkpoint, so every row comes once, whatever is restarted between.
Pages go by key, not by position, so rows that come while reading shift nothing.

A service is a function ``fetch(url, low, high, limit)``: the first ``limit`` rows, as
dictionaries, with low < key <= high, in the key's order (low None: from the start; high None:
to the end).  It is named by ``module:function``; ``http_rows`` is one for JSON over HTTP."""

from __future__ import annotations

import importlib
import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


def http_rows(url: str, low: int | None, high: int | None, limit: int, key: str = "id", timeout: int = 60) -> list[dict]:
    """Rows of a service that takes ``after``, ``upto``, ``limit`` and ``order``."""
    asked = {"order": key, "limit": limit} | ({} if low is None else {"after": low}) | ({} if high is None else {"upto": high})
    with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(asked)}", timeout=timeout) as answer:
        return json.load(answer)


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _Pages:
    """What both readers share."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.url, self.key = options["url"], options.get("key", "id")
        self.limit = int(options.get("limit", "500"))
        if self.limit < 1:
            raise ValueError("a page has one row at least")
        self.names, (module, name) = schema.fieldNames(), options.get("fetch", f"{__name__}:http_rows").split(":")
        self.fetch = getattr(importlib.import_module(module), name)

    def pages(self, low: int | None, high: int | None) -> Iterator[list[dict]]:
        while True:
            rows = self.fetch(self.url, low, high, self.limit)
            if rows:
                yield rows
            if len(rows) < self.limit:
                return
            last = rows[-1][self.key]
            if low is not None and last <= low:
                raise ValueError(f"{self.url} gave key {last} again after {low}")
            low = last

    def read(self, part: _Range) -> Iterator[tuple]:
        for rows in self.pages(part.low, part.high):
            for row in rows:
                yield tuple(row.get(c) for c in self.names)


class _Batch(_Pages, DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        _Pages.__init__(self, options, schema)
        self.parts = int(options.get("partitions", "1"))
        self.bounds = options.get("lower"), options.get("upper")

    def partitions(self) -> list[InputPartition]:
        if self.parts < 2 or None in self.bounds:
            return [_Range(None, None)]
        low, high = map(int, self.bounds)
        cuts = sorted({low + (high - low) * i // self.parts for i in range(1, self.parts)})
        # the first and the last range are open, so that rows beyond the stated bounds are read too
        return [_Range(a, z) for a, z in zip([None, *cuts], [*cuts, None])]


class _Stream(_Pages, DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        _Pages.__init__(self, options, schema)
        self.most = int(options.get("pagesPerBatch", "20"))
        self.at: int | None = None

    def initialOffset(self) -> dict:
        return {"key": None}

    def latestOffset(self) -> dict:
        """The key some pages on from where the last batch ended: a batch is bounded."""
        for n, rows in enumerate(self.pages(self.at, None), 1):
            self.at = rows[-1][self.key]
            if n >= self.most:
                break
        return {"key": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # after a restart this names the last batch that was planned
        if self.at is None or (end["key"] is not None and end["key"] > self.at):
            self.at = end["key"]
        return [_Range(start["key"], end["key"])] if end["key"] is not None and start["key"] != end["key"] else []

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    """``spark.dataSource.register(PagedSource)``; then ``spark.read.format("paged")`` or
    ``spark.readStream.format("paged")`` with a schema and the options url, key (an integer
    column, default id), limit (rows of a page), fetch, for batches partitions with lower and
    upper, and for streams pagesPerBatch."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options, schema)
