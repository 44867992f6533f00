"""A paged search service as a Spark data source: `spark.read.format("paged_search")`, and readStream.

Options: fetcher (`module:function`, called with a URL in the tasks, gives status and body), base, query, start and
end dates, frequency (monthly, weekly, daily), page (records in a response), column (the date field), schema,
rate (requests a second over all tasks, none by default), tasks, retries.

A scan asks for the number of hits of each date bucket while it is planned; a partition is a run of pages
of one bucket. Conditions on the date column drop buckets before anything is asked, and are checked again on
the rows (this takes `spark.sql.python.filterPushdown.enabled`). As a stream, offsets are numbers of buckets: a restarted query goes on after the last that was
committed, and a trigger takes `bucketsPerTrigger` of them.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType


class Pages(InputPartition):
    """Some pages, by their first record, of the bucket from `first` to `last`."""

    def __init__(self, first: date, last: date, pages: tuple[int, ...], pause: float):
        self.first, self.last, self.pages, self.pause = first, last, pages, pause


def buckets(start: date, end: date, frequency: str) -> list[tuple[date, date]]:
    """(first, last day) of every whole or begun month, week or day from start to end."""
    out, at = [], start
    while at <= end:
        after = {"daily": at + timedelta(1), "weekly": at + timedelta(7), "monthly": date(at.year + at.month // 12, at.month % 12 + 1, 1)}[frequency]
        out.append((at, min(after - timedelta(1), end)))
        at = after
    return out


class Search:
    """What the readers share."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema
        self.column, self.page = options.get("column", "date"), int(options.get("page", 1000))
        self.every = buckets(date.fromisoformat(options["start"]), date.fromisoformat(options["end"]), options.get("frequency", "monthly"))

    def url(self, first: date, last: date, start: int, rows: int) -> str:
        o = self.options
        between = quote(f"{self.column}:[{first}T00:00:00Z TO {last}T23:59:59Z]", safe="")
        return f"{o['base']}/select?q={quote(o.get('query', '*:*'), safe='')}&fq={between}&start={start}&rows={rows}"

    def ask(self, url: str) -> dict:
        """The response; errors are tried again, and raise when they stay, so that Spark repeats the task."""
        module, _, name = self.options["fetcher"].partition(":")
        fetch, tries = getattr(importlib.import_module(module), name), int(self.options.get("retries", 2)) + 1
        for i in range(tries):
            status, body = fetch(url)
            if status == 200:
                return json.loads(body)["response"]
            if i + 1 < tries:
                time.sleep(float(self.options.get("backoff", 0.1)) * 2**i)
        raise OSError(f"status {status} from {url}")

    def plan(self, some: list[tuple[date, date]]) -> list[Pages]:
        """Partitions of at most a few pages, and the pause between the requests of one task, so that all
        together keep to the rate."""
        tasks, rate = int(self.options.get("tasks", 4)), float(self.options.get("rate", 0))
        out = []
        for first, last in some:
            hits = int(self.ask(self.url(first, last, 0, 0))["numFound"])
            starts = list(range(0, hits, self.page))
            each = max(1, -(-len(starts) // tasks))
            out += [(first, last, tuple(starts[i : i + each])) for i in range(0, len(starts), each)]
        pause = min(tasks, max(1, len(out))) / rate if rate else 0.0
        return [Pages(*p, pause) for p in out]

    def rows(self, part: Pages) -> Iterator[tuple]:
        for i, start in enumerate(part.pages):
            if i and part.pause:
                time.sleep(part.pause)
            for doc in self.ask(self.url(part.first, part.last, start, self.page))["docs"]:
                yield tuple(_value(doc.get(f.name), f.dataType.simpleString()) for f in self.schema.fields)


def _value(x, kind: str):
    if x is None:
        return None
    if kind == "timestamp":
        return datetime.fromisoformat(x.replace("Z", "+00:00"))
    if kind == "date":
        return date.fromisoformat(x[:10])
    if kind == "string" and not isinstance(x, str):
        return json.dumps(x)
    return float(x) if kind == "double" else x


class PagedReader(DataSourceReader):
    def __init__(self, search: Search):
        self.search, self.wanted = search, search.every

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps the buckets that a condition on the date column can meet; all are checked again by Spark."""
        for f in filters:
            yield f
            if getattr(f, "attribute", None) != (self.search.column,) or not isinstance(getattr(f, "value", None), (date, datetime)):
                continue
            day = f.value.date() if isinstance(f.value, datetime) else f.value
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.wanted = [b for b in self.wanted if b[1] >= day - timedelta(1)]  # a day aside for time zones
            if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.wanted = [b for b in self.wanted if b[0] <= day + timedelta(1)]

    def partitions(self) -> list[Pages]:
        return self.search.plan(self.wanted)

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.search.rows(partition)


class PagedStream(DataSourceStreamReader):
    def __init__(self, search: Search):
        self.search, self.step, self.at = search, int(search.options.get("bucketsPerTrigger", 1)), None

    def initialOffset(self) -> dict:
        return {"bucket": 0}

    def latestOffset(self) -> dict:
        """Some buckets further than the last."""
        self.at = min((self.at or 0) + self.step, len(self.search.every))
        return {"bucket": self.at}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        self.at = max(self.at or 0, end["bucket"])
        return self.search.plan(self.search.every[start["bucket"] : end["bucket"]])

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.search.rows(partition)

    def commit(self, end: dict) -> None:
        """Spark keeps the offsets."""


class PagedSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return self.options.get("schema", "id string, date timestamp, title string")

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(Search(dict(self.options), schema))

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(Search(dict(self.options), schema))
