"""Paged news as a Python data source (SRC-3, LIM-1).

One input partition per time interval; a partition asks for its pages one after the other,
because each page names the next. A page becomes one row of raw JSON, so parsing and validation
are the same as for the landed stream.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from newsprep.functions.dates import parse_rfc3339
from newsprep.operators.intervals import in_range
from newsprep.operators.parse import explode_messages, good_rows, reject_rows, validate

# Fixed value: the stamp of request parameters, as in ``iso_z``.
_STAMP = "%Y-%m-%dT%H:%M:%SZ"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_PAGE = pa.schema([
    ("interval", pa.int64()), ("interval_start", pa.timestamp("us", "UTC")), ("interval_end", pa.timestamp("us", "UTC")),
    ("page", pa.int64()), ("value", pa.string()),
])


def _micros(stamp: str) -> int:
    at = datetime.fromisoformat(stamp)
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return (at - _EPOCH) // timedelta(microseconds=1)


def _at(micros: int) -> datetime:
    return _EPOCH + timedelta(microseconds=micros)


@dataclass
class Interval(InputPartition):
    number: int
    start: int
    end: int


class PagedNews(DataSource):
    """Options: ``start``, ``end``, ``n``, ``page_size`` (50) and ``fetcher``, a ``module:factory``.

    The factory receives all options and returns
    ``fetch_page(start, end, limit, token) -> {"news": [...], "next_page_token": str or None}``,
    with articles ascending in time. It raises on a failed request.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_news"

    def schema(self) -> str:
        return "interval bigint, interval_start timestamp, interval_end timestamp, page bigint, value string"

    def reader(self, schema) -> "PagedNewsReader":
        return PagedNewsReader(dict(self.options))


class PagedNewsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Interval]:
        lo, hi = _micros(self.options["start"]), _micros(self.options["end"])
        n = int(self.options.get("n", 1))
        edges = [lo + -(-i * (hi - lo) // n) for i in range(n + 1)]
        return [Interval(i, edges[i], edges[i + 1]) for i in range(n)]

    def read(self, partition: Interval) -> Iterator[pa.RecordBatch]:
        """One batch per page: rows would be held until ten thousand of them make a batch."""
        module, factory = self.options["fetcher"].split(":")
        fetch_page = getattr(importlib.import_module(module), factory)(self.options)
        start, end = _at(partition.start), _at(partition.end)
        # Requests carry whole seconds; rows outside the interval are dropped after parsing.
        asked_end = end if end.microsecond == 0 else end.replace(microsecond=0) + timedelta(seconds=1)
        token, page = None, 0
        while True:
            try:
                answer = fetch_page(
                    start.strftime(_STAMP), asked_end.strftime(_STAMP), int(self.options.get("page_size", 50)), token
                )
            except Exception as failure:
                raise RuntimeError(f"page {page} (token {token}) of interval {partition.number} failed: {failure}") from failure
            yield pa.RecordBatch.from_arrays([
                pa.array([x], f.type) for x, f in zip((partition.number, start, end, page, json.dumps(answer["news"])), _PAGE)
            ], schema=_PAGE)
            token, page = answer.get("next_page_token"), page + 1
            if token is None:
                return


def read_pages(spark: SparkSession, start: str, end: str, n: int, fetcher: str, page_size: int = 50, **options: str) -> DataFrame:
    """SRC-3: raw pages of ``[start, end)``, read by ``n`` tasks."""
    spark.dataSource.register(PagedNews)
    reader = spark.read.format("paged_news").options(
        start=start, end=end, n=str(n), fetcher=fetcher, page_size=str(page_size), **options
    )
    return reader.load()


def parse_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """News rows and rejects of the pages, each in the interval that asked for it.

    Two intervals that share a second are both sent its messages; those that can be dated count once.
    """
    validated = validate(explode_messages(pages))
    created = parse_rfc3339("message.created_at")
    mine = validated.where(created.isNull() | in_range(created, F.col("interval_start"), F.col("interval_end")))
    return good_rows(mine), reject_rows(mine)
