"""Connectors: kinds of sources behind one interface, read by one Python data source, batch and stream.

A connector lists its jobs (``discover``) and gives a job's items page by page
(``fetch``); everything else is shared. ``spark.read.format(<name>)`` makes one
task of each job, several where the connector can ``split`` it. Filters on ``repo`` and ``kind`` choose jobs, a lower bound of ``seen``
reaches the connector as the jobs' ``since``, so that pages known to be older are not opened;
Spark repeats all filters on the rows, so the rows are those of a filter above
the source. ``spark.readStream.format(<name>)`` follows cursors of its own, one a job:
the next page and the item in it.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import UTC, datetime
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

RAW = "repo string, kind string, page int, item string, seen timestamp"
#: ``seen`` of items that have no time of change: no lower bound leaves them out.
ALWAYS = datetime(9000, 1, 1, tzinfo=UTC)
Item = tuple[str, datetime]


@dataclass(frozen=True)
class Job(InputPartition):
    """One repository and kind of a source, from a page on or some pages (``numbers``), of what changed since a time."""

    source_type: str
    repo: str
    kind: str
    cursor: str | None = None
    since: datetime | None = None
    numbers: tuple[int, ...] = ()

    @property
    def source_id(self) -> str:
        return f"{self.source_type}:{self.repo}"


@dataclass(frozen=True)
class Page:
    """What is known of a page without opening it: how many items it has and the latest time among them."""

    number: int
    items: int
    newest: datetime | None = None


class Connector(ABC):
    """A kind of source. ``options`` are those of the data source."""

    source_type: ClassVar[str]

    def __init__(self, options: Mapping[str, str]):
        self.options = options

    @abstractmethod
    def discover(self) -> list[Job]:
        """All jobs of the configuration."""

    @abstractmethod
    def fetch(self, job: Job) -> tuple[list[Item], Job | None]:
        """The items of the page that the job's cursor names, each as JSON with its time, and the job of the next page."""

    def read(self, job: Job) -> Iterator[tuple[int, Item]]:
        """A job's items with their page, to its end; a connector that knows its pages may skip those older than ``since``."""
        at: Job | None = job
        while at:
            number = int(at.cursor or 1)
            items, at = self.fetch(at)
            for item in items:
                yield number, item

    def split(self, job: Job) -> tuple[list[tuple[int, ...]], Job | None]:
        """Groups of a job's pages that tasks may read apart, and the job of what has to be read in order; here all of it."""
        return [], job

    def pages(self, jobs: Sequence[Job]) -> dict[Job, list[Page]]:
        """The pages that are there now, in order, for a stream."""
        raise NotImplementedError(f"{self.source_type} cannot be followed as a stream")

    def items(self, job: Job, number: int, first: int, last: int) -> list[Item]:
        """Items ``first`` to ``last`` (exclusive) of one page, for a stream."""
        raise NotImplementedError(f"{self.source_type} cannot be followed as a stream")

    @staticmethod
    @abstractmethod
    def normalize(raw: DataFrame, since: datetime | None = None) -> DataFrame:
        """Documents of raw rows."""


def utc(value: datetime) -> datetime:
    return value.astimezone(UTC) if value.tzinfo else value.replace(tzinfo=UTC)


def _rows(job: Job, found: Iterator[tuple[int, Item]]) -> Iterator[tuple]:
    for number, (item, seen) in found:
        yield job.repo, job.kind, number, item, seen


class ConnectorReader(DataSourceReader):
    """A task for each job that the filters leave, or several where the connector knows the job's pages."""

    def __init__(self, connector: Connector):
        self.connector, self.since = connector, None
        self.only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("seen",):
                self.since = max(utc(f.value), self.since or utc(f.value))
            elif isinstance(f, (EqualTo, In)) and f.attribute in (("repo",), ("kind",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[f.attribute[0]] = values & self.only.get(f.attribute[0], values)
            yield f  # a page holds other rows too, so Spark applies every filter again

    def partitions(self) -> list[Job]:
        wanted = [j for j in self.connector.discover() if all(getattr(j, name) in values for name, values in self.only.items())]
        out: list[Job] = []
        for job in wanted:
            job = replace(job, since=max(filter(None, (job.since, self.since)), default=None))
            groups, rest = self.connector.split(job)
            out += [replace(job, numbers=numbers) for numbers in groups] + ([rest] if rest else [])
        return out

    def read(self, partition: Job | None) -> Iterator[tuple]:
        if partition is None:  # what Spark asks for where there are no partitions
            return iter(())
        if partition.numbers:
            return _rows(partition, ((n, item) for n in partition.numbers for item in self.connector.fetch(replace(partition, cursor=str(n)))[0]))
        return _rows(partition, self.connector.read(partition))


@dataclass(frozen=True)
class Stretch(InputPartition):
    """Parts of a job's pages: (page, first item, item after the last)."""

    job: Job
    parts: tuple[tuple[int, int, int], ...]


class ConnectorStream(DataSourceStreamReader):
    """Offsets name each job's next page and item, ``{"<repo>|<kind>": {"page": 3, "item": 0}}``.

    The end of a job is its first page that is not full: the stream waits there until the
    page has more items, or is full and has a successor. Pages are read by
    executors, at most ``pages_a_task`` (an option) by one task; the driver sees their sizes only.
    """

    def __init__(self, connector: Connector):
        self.connector = connector
        self.size, self.step = int(connector.options.get("page_size", "100")), int(connector.options.get("pages_a_task", "20"))

    @staticmethod
    def _key(job: Job) -> str:
        return f"{job.repo}|{job.kind}"

    def initialOffset(self) -> dict:
        return {self._key(j): {"page": 1, "item": 0} for j in self.connector.discover()}

    def latestOffset(self) -> dict:
        jobs, out = self.connector.discover(), {}
        there = self.connector.pages(jobs)
        for job in jobs:
            at = {"page": 1, "item": 0}
            for page in there.get(job, []):
                if page.items < self.size:
                    at = {"page": page.number, "item": page.items}
                    break
                at = {"page": page.number + 1, "item": 0}
            out[self._key(job)] = at
        return out

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for job in self.connector.discover():
            a, b = start.get(self._key(job), {"page": 1, "item": 0}), end.get(self._key(job))
            if not b or (b["page"], b["item"]) <= (a["page"], a["item"]):
                continue
            last = b["page"] if b["item"] else b["page"] - 1
            parts = [(p, a["item"] if p == a["page"] else 0, b["item"] if p == b["page"] else -1) for p in range(a["page"], last + 1)]
            out += [Stretch(job, tuple(parts[i : i + self.step])) for i in range(0, len(parts), self.step)]
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        for number, first, last in partition.parts:
            yield from _rows(partition.job, ((number, x) for x in self.connector.items(partition.job, number, first, last)))

    def commit(self, end: dict) -> None:
        return None

    def stop(self) -> None:
        return None


class ConnectorSource(DataSource):
    """The data source of a connector; a subclass names both."""

    connector: ClassVar[type[Connector]]
    format_name: ClassVar[str]

    @classmethod
    def name(cls) -> str:
        return cls.format_name

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> ConnectorReader:
        return ConnectorReader(self.connector(self.options))

    def streamReader(self, schema) -> ConnectorStream:
        return ConnectorStream(self.connector(self.options))


_SOURCES: dict[str, type[ConnectorSource]] = {}


def connects(source: type[ConnectorSource]) -> type[ConnectorSource]:
    """Make a connector's data source known by its type; as a class decorator."""
    _SOURCES[source.connector.source_type] = source
    return source


def source_for(source_type: str) -> type[ConnectorSource]:
    """The data source of a type of sources."""
    if source_type not in _SOURCES:
        raise ValueError(f"no connector for {source_type}; there are {', '.join(sorted(_SOURCES))}")
    return _SOURCES[source_type]


def read(spark: SparkSession, source_type: str, options: Mapping[str, object], since: datetime | None = None) -> DataFrame:
    """Raw rows of a source; with ``since``, those seen from then on."""
    rows = _registered(spark, source_type, spark.read, options).load()
    return rows if since is None else rows.where(rows["seen"] >= since)


def follow(spark: SparkSession, source_type: str, options: Mapping[str, object]) -> DataFrame:
    """Raw rows of a source as a stream."""
    return _registered(spark, source_type, spark.readStream, options).load()


def _registered(spark: SparkSession, source_type: str, reader, options: Mapping[str, object]):
    source = source_for(source_type)
    register(spark, source)
    return reader.format(source.name()).options(**{k: str(v) for k, v in options.items()})


def register(spark: SparkSession, *sources: type[ConnectorSource]) -> None:
    """Register data sources (all known ones by default) and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in sources or _SOURCES.values():
        spark.dataSource.register(source)
