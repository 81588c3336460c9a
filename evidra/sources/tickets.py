"""Tickets of a paged service as a Spark source, for batches and as a stream.

A service answers two calls: how many tickets match a query, and one page of them after a token. The time
asked for is cut into windows of whole days, each a partition that walks its own pages, so a long history is
read by many tasks. Filters on key, status, creation time and words of the summary go to the service; a limit
is dealt to the windows by their counts, newest first, so pages beyond it aren't asked for. A stream's offset
is a time: the windows between two offsets read the same tickets again after a failure.

The module needs no other of this package, so its classes travel to the workers by value.
"""

from __future__ import annotations

import json
import random
import sys
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from datetime import date, datetime, timedelta, timezone
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

SCHEMA = "key string, created timestamp, status string, summary string, fields string"
NAME = "tickets"


@dataclass(frozen=True)
class Query:
    """Half-open days, newest first. Empty ``keys`` and ``words`` ask for all, ``exclude`` leaves keys out."""

    project: str = "DEMO"
    status: str | None = "Resolved"
    start: date | None = None
    end: date | None = None
    words: tuple[str, ...] = ()
    keys: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()

    def text(self) -> str:
        """The query in the service's language."""
        quoted = lambda values: ", ".join(f'"{v}"' for v in values)
        parts = [f"project = {self.project}"]
        parts += [f"status = {self.status}"] if self.status else []
        parts += [f"created >= '{self.start}'"] if self.start else []
        parts += [f"created < '{self.end}'"] if self.end else []
        parts += ["(" + " OR ".join(f'summary ~ "{w}"' for w in self.words) + ")"] if self.words else []
        parts += [f"key NOT IN ({quoted(self.exclude)})"] if self.exclude else []
        parts += [f"key IN ({quoted(self.keys)})"] if self.keys else []
        return " AND ".join(parts) + " ORDER BY created DESC"

    def holds(self, key: str, created: datetime, status: str, summary: str | None) -> bool:
        low = (summary or "").lower()
        return (
            (self.status is None or status == self.status) and (self.start is None or created.date() >= self.start) and (self.end is None or created.date() < self.end)
            and (not self.words or any(w.lower() in low for w in self.words)) and key not in self.exclude and (self.keys is None or key in self.keys)
        )


@dataclass
class Page:
    tickets: list[tuple]  # (key, created, status, summary, fields)
    token: str | None = None


class Service(Protocol):
    """What a paged service has to answer; an object that travels to the workers."""

    def days(self) -> tuple[date, date] | None: ...  # the first day and the day after the last, None without tickets

    def count(self, query: Query) -> int: ...

    def page(self, query: Query, token: str | None, size: int) -> Page: ...


class Busy(Exception):
    """A call that may succeed later."""


def tried(call: Callable, tries: int = 5, first: float = 1.0, most: float = 30.0, jitter: float = 0.1, sleep: Callable = time.sleep):
    """``call()``, again after ``Busy`` or a lost connection; waits double from ``first`` to ``most``, and a random part is added."""
    for n in range(1, tries + 1):
        try:
            return call()
        except (Busy, ConnectionError, TimeoutError):
            if n == tries:
                raise
            sleep(min(most, first * 2 ** (n - 1)) * (1 + random.random() * jitter))


def walked(service: Service, query: Query, size: int, limit: int | None = None, wait: float = 1.0) -> Iterator[tuple]:
    """All tickets of a query, page after page, ``limit`` at most; the last page is asked for no larger than is left."""
    token = None
    while limit is None or limit > 0:
        page = tried(lambda: service.page(query, token, size if limit is None else min(size, limit)), first=wait)  # noqa: B023
        yield from page.tickets if limit is None else page.tickets[:limit]
        limit = None if limit is None else limit - len(page.tickets)
        token = page.token
        if token is None:
            return


@dataclass
class Window(D.InputPartition):
    query: Query
    limit: int | None = None


@dataclass
class Plan:
    service: Service
    query: Query
    size: int
    days: int
    limit: int | None
    wait: float

    @classmethod
    def of(cls, options: Mapping[str, str]) -> Plan:
        """Options: service (see ``service_option``), project, status, start, end, words and exclude (JSON lists), pageSize, windowDays, limit, wait."""
        import base64

        from pyspark import cloudpickle

        day = lambda name: date.fromisoformat(options[name]) if options.get(name) else None
        listed = lambda name: tuple(json.loads(options.get(name) or "[]"))
        query = Query(options.get("project", "DEMO"), options.get("status", "Resolved") or None, day("start"), day("end"), listed("words"), None, listed("exclude"))
        size, days, limit = int(options.get("pagesize", 100)), int(options.get("windowdays", 30)), options.get("limit")
        if size < 1 or days < 1 or (limit is not None and int(limit) < 0):
            raise ValueError("pageSize and windowDays are 1 or more, limit is not negative")
        return cls(cloudpickle.loads(base64.b64decode(options["service"])), query, size, days, None if limit is None else int(limit), float(options.get("wait", 1)))

    def windows(self, query: Query) -> list[Window]:
        """Newest first; with a limit only those that its tickets come from."""
        held = self.service.days()
        if held is None or query.keys == ():
            return []
        start, end = max(query.start or held[0], held[0]), min(query.end or held[1], held[1])
        out, left = [], self.limit
        while start < end and (left is None or left > 0):
            begin = max(start, end - timedelta(days=self.days))
            part = replace(query, start=begin, end=end)
            if left is None:
                out.append(Window(part))
            elif n := tried(lambda: self.service.count(part), first=self.wait):  # noqa: B023
                out.append(Window(part, min(n, left)))
                left -= min(n, left)
            end = begin
        return out


class Reader(D.DataSourceReader):
    def __init__(self, plan: Plan) -> None:
        self.plan, self.query = plan, plan.query

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        """What the service can answer is left to it whole, times to the day only; with a limit nothing is, as it comes first."""
        for f in filters:
            known = self.plan.limit is None and self._took(f)
            if not known:
                yield f

    def _took(self, f: D.Filter) -> bool:
        """Narrows the query by ``f``; whether Spark need not look at ``f`` again."""
        q, name = self.query, getattr(f, "attribute", ("",))[0]
        inner = f.child if isinstance(f, D.Not) else None
        if isinstance(f, D.EqualTo) and name == "key" or isinstance(f, D.In) and name == "key":
            keys = (f.value,) if isinstance(f, D.EqualTo) else tuple(f.value)
            self.query = replace(q, keys=tuple(k for k in keys if q.keys is None or k in q.keys))
            return True
        if inner is not None and getattr(inner, "attribute", ("",))[0] == "key" and isinstance(inner, (D.EqualTo, D.In)):
            gone = (inner.value,) if isinstance(inner, D.EqualTo) else tuple(inner.value)
            self.query = replace(q, exclude=(*q.exclude, *gone))
            return True
        if isinstance(f, D.EqualTo) and name == "status":
            if q.status is None:
                self.query = replace(q, status=f.value)
            return q.status is None or q.status == f.value
        if isinstance(f, (D.GreaterThan, D.GreaterThanOrEqual)) and name == "created":
            self.query = replace(q, start=max(filter(None, (q.start, _utc(f.value).date()))))
        if isinstance(f, (D.LessThan, D.LessThanOrEqual)) and name == "created":
            self.query = replace(q, end=min(filter(None, (q.end, _utc(f.value).date() + timedelta(days=1)))))
        return False

    def partitions(self) -> list[D.InputPartition]:
        return self.plan.windows(self.query) or [D.InputPartition(None)]

    def read(self, partition: D.InputPartition) -> Iterator[tuple]:
        if isinstance(partition, Window):
            yield from walked(self.plan.service, partition.query, self.plan.size, partition.limit, self.plan.wait)


class Stream(D.DataSourceStreamReader):
    """New days as they come; a day is read when the next one has begun, so that it is whole."""

    def __init__(self, plan: Plan) -> None:
        self.plan = plan

    def initialOffset(self) -> dict:
        held = self.plan.service.days()
        first = self.plan.query.start or (held[0] if held else None)
        return {"day": first.isoformat() if first else None}

    def latestOffset(self) -> dict:
        held = self.plan.service.days()
        if held is None:
            return self.initialOffset()
        last = held[1] - timedelta(days=1)
        return {"day": max(min(last, self.plan.query.end or last), date.fromisoformat(self.initialOffset()["day"])).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[D.InputPartition]:
        if end["day"] is None or start["day"] == end["day"]:
            return []
        begin = date.fromisoformat(start["day"]) if start["day"] else None
        return self.plan.windows(replace(self.plan.query, start=begin, end=date.fromisoformat(end["day"])))

    def read(self, partition: D.InputPartition) -> Iterator[tuple]:
        yield from walked(self.plan.service, partition.query, self.plan.size, None, self.plan.wait)


class TicketSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(Plan.of(self.options))

    def streamReader(self, schema) -> Stream:
        return Stream(Plan.of(self.options))


def _utc(t: datetime) -> datetime:
    return t.astimezone(timezone.utc) if t.tzinfo else t


def register(spark: SparkSession) -> None:
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TicketSource)


def service_option(service: Service) -> str:
    """The service as the text that the option ``service`` takes."""
    import base64

    from pyspark import cloudpickle

    return base64.b64encode(cloudpickle.dumps(service)).decode()


@dataclass
class Export:
    """A service's export: a folder a day (``day=2024-02-29``) of files with a JSON ticket a line. Any file system that Arrow knows.

    Days and lines are the newest first as they lie; a token is day, file and the byte at which the next ticket's line
    begins, so a page costs what it reads and not what came before. ``calls``, if given, is a folder that gets an empty
    file for each page, to see what was asked for.
    """

    root: str
    calls: str | None = None
    _held: dict = field(default_factory=dict, repr=False)

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else f"file://{self.root}")

    def _days(self) -> list[date]:
        from pyarrow import fs

        at, path = self._fs()
        names = [i.base_name for i in at.get_file_info(fs.FileSelector(path)) if i.base_name.startswith("day=")]
        return sorted((date.fromisoformat(n[4:]) for n in names), reverse=True)

    def _lines(self, day: date, name: str, start: int) -> Iterator[tuple[str, int, bytes]]:
        """(file, byte, line) of a day from this file and byte on."""
        from pyarrow import fs

        at, path = self._fs()
        for info in sorted(at.get_file_info(fs.FileSelector(f"{path}/day={day}")), key=lambda i: i.base_name):
            if info.base_name[0] not in "._" and info.base_name >= name:
                skip = start if info.base_name == name else 0
                if info.base_name.rpartition(".")[2] in PACKED:  # no way to a byte but through those before
                    with at.open_input_stream(info.path) as raw:
                        left = skip
                        while left and (block := raw.read(min(left, 1 << 20))):
                            left -= len(block)
                        yield from ((info.base_name, i, line) for i, line in _split(raw, skip))
                else:
                    with at.open_input_file(info.path) as raw:
                        raw.seek(skip)
                        yield from ((info.base_name, i, line) for i, line in _split(raw, skip))

    def days(self) -> tuple[date, date] | None:
        found = self._days()
        return (found[-1], found[0] + timedelta(days=1)) if found else None

    def _found(self, query: Query, at: tuple[str, str, int] | None) -> Iterator[tuple[tuple[str, str, int], tuple]]:
        """The tickets of a query with their places, from the place ``at`` on."""
        for day in self._days():
            if (query.start and day < query.start) or (query.end and day >= query.end) or (at and str(day) > at[0]):
                continue
            for name, i, line in self._lines(day, *(at[1:] if at and str(day) == at[0] else ("", 0))):
                if line.strip():
                    t = json.loads(line)
                    row = (t["key"], _utc(datetime.fromisoformat(t["created"].replace("Z", "+00:00"))), t["status"], t.get("summary"), json.dumps(t.get("fields") or {}, sort_keys=True))
                    if query.holds(*row[:4]):
                        yield (str(day), name, i), row

    def count(self, query: Query) -> int:
        return sum(1 for _ in self._found(query, None))

    def page(self, query: Query, token: str | None, size: int) -> Page:
        if self.calls:
            import os
            import uuid

            open(os.path.join(self.calls, uuid.uuid4().hex), "w").close()
        rows: list[tuple] = []
        for at, row in self._found(query, tuple(json.loads(token)) if token else None):
            if len(rows) == size:
                return Page(rows, json.dumps(at))
            rows.append(row)
        return Page(rows)


#: Names' ends of files that Arrow unpacks as it reads.
PACKED = ("gz", "bz2", "lz4", "zst")


def _split(raw, at: int) -> Iterator[tuple[int, bytes]]:
    """Lines with the bytes at which they begin, the first at ``at``."""
    rest: list[bytes] = []  # of a line that isn't over yet
    while block := raw.read(1 << 18):
        first, *lines = block.split(b"\n")
        rest.append(first)
        for x in lines:
            whole = b"".join(rest)
            yield at, whole
            at += len(whole) + 1
            rest = [x]
    if any(rest):
        yield at, b"".join(rest)


def read(spark: SparkSession, service: Service, **options: object):
    """Tickets of a service as a DataFrame; see ``Plan.of`` for the options."""
    register(spark)
    text = {k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items()}
    return spark.read.format(NAME).options(service=service_option(service), **text).load()


def read_stream(spark: SparkSession, service: Service, **options: object):
    register(spark)
    text = {k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items()}
    return spark.readStream.format(NAME).options(service=service_option(service), **text).load()
