"""A polled provider as a Spark data source: pages by token, resumed from the checkpoint."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "external_id string, title string, published_day int"


def page(token: int, size: int) -> list[tuple]:
    """The deterministic items of one page."""
    return [(f"item-{i:06d}", f"Item {i}", i // 7) for i in range(token * size, (token + 1) * size)]


class PageReader(DataSourceReader):
    """Batch: a partition for each page."""

    def __init__(self, options):
        self.pages, self.size = int(options.get("pages", 3)), int(options.get("size", 10))

    def partitions(self):
        return [InputPartition(i) for i in range(self.pages)]

    def read(self, partition) -> Iterator[tuple]:
        yield from page(partition.value, self.size)


def _now(options) -> datetime:
    return datetime.fromisoformat(options["now"]) if "now" in options else datetime.now(timezone.utc).replace(tzinfo=None)


class PageStream(SimpleDataSourceStreamReader):
    """Stream of pages, newest first; the offset says where a scan stands and what that is good for.

    An offset holds the next page's ``token``, the ``fingerprint`` of what is
    scanned, ``at``, and how many pages without news came last. An offset of
    another fingerprint or older than ``ttl_hours`` is not continued: the scan
    starts anew. Items from number ``known_from`` on are known, so a scan ends
    after ``stop_after`` pages in a row of such (0: never).
    """

    def __init__(self, options):
        self.pages, self.size = int(options.get("pages", 3)), int(options.get("size", 10))
        self.known_from, self.stop_after = int(options.get("known_from", 1 << 62)), int(options.get("stop_after", 0))
        self.ttl, self.options = timedelta(hours=float(options.get("ttl_hours", 24))), options
        told = f"{options.get('advertiser', '')}|{options.get('region', '')}|{self.size}|newest-first"
        self.fingerprint = hashlib.sha256(told.encode()).hexdigest()[:24]

    def _anew(self):
        return {"token": 0, "fingerprint": self.fingerprint, "at": _now(self.options).isoformat(), "still": 0}

    def initialOffset(self):
        checkpoint = self.options.get("checkpoint")
        return self._current(json.loads(checkpoint)) if checkpoint else self._anew()

    def _current(self, offset):
        holds = offset.get("fingerprint") == self.fingerprint and _now(self.options) - datetime.fromisoformat(offset["at"]) <= self.ttl
        return offset if holds else self._anew()

    def _done(self, offset):
        return offset["token"] >= self.pages or 0 < self.stop_after <= offset["still"]

    def _after(self, offset):
        quiet = offset["token"] * self.size >= self.known_from
        return {"token": offset["token"] + 1, "fingerprint": self.fingerprint, "at": _now(self.options).isoformat(), "still": offset["still"] + 1 if quiet else 0}

    def read(self, start):
        offset = self._current(start)
        if self._done(offset):
            return iter([]), offset if offset != start and offset["token"] == 0 else start
        return iter(page(offset["token"], self.size)), self._after(offset)

    def readBetweenOffsets(self, start, end):
        begin = start["token"] if start["token"] < end["token"] and start["fingerprint"] == end["fingerprint"] else 0
        return iter([row for t in range(begin, end["token"]) for row in page(t, self.size)])


class ReplaySource(DataSource):
    """``spark.read.format("brightloom_replay")``: deterministic items for tests and dry runs."""

    @classmethod
    def name(cls):
        return "brightloom_replay"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return PageReader(self.options)

    def simpleStreamReader(self, schema: StructType):
        return PageStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReplaySource)
