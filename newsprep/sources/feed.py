"""A live news feed as a streaming data source (SRC-4, SRC-5).

The caller supplies the feed as a log with positions: how far it reaches, and the frames of a range.
Spark keeps the offsets; after a restart it asks for the same ranges again, so nothing is lost or
repeated. Frames come as raw JSON, as in the landing folder, and are parsed by the same operators.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


@dataclass
class Range(InputPartition):
    start: int
    end: int


class NewsFeed(DataSource):
    """Options: ``feed``, a ``module:factory``, ``symbols`` (comma-separated, ``*`` for all), ``start`` (0), ``splits`` (1).

    The factory receives all options and returns an object with ``latest() -> int``, the position after
    the last frame, and ``frames(start, end) -> iterable of (position, text)`` of the frames with ``start <= position < end``,
    the same ones whenever it is asked. It subscribes to the symbols itself; others are sent on as they come.
    """

    @classmethod
    def name(cls) -> str:
        return "news_feed"

    def schema(self) -> str:
        return "position bigint, value string"

    def streamReader(self, schema) -> "FeedReader":
        return FeedReader(dict(self.options))


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def _feed(self):
        module, factory = self.options["feed"].split(":")
        return getattr(importlib.import_module(module), factory)(self.options)

    def initialOffset(self) -> dict:
        return {"position": int(self.options.get("start", 0))}

    def latestOffset(self) -> dict:
        return {"position": max(self._feed().latest(), int(self.options.get("start", 0)))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high, n = start["position"], end["position"], int(self.options.get("splits", 1))
        edges = [low + i * (high - low) // n for i in range(n + 1)]
        return [Range(a, b) for a, b in zip(edges, edges[1:]) if a < b]

    def read(self, partition: Range) -> Iterator[tuple]:
        for position, text in self._feed().frames(partition.start, partition.end):
            if not partition.start <= position < partition.end:
                raise ValueError(f"the feed sent position {position} for {partition.start} to {partition.end}")
            yield position, text

    def commit(self, end: dict) -> None:
        feed = self._feed()
        if hasattr(feed, "done"):  # the feed may forget what lies before
            feed.done(end["position"])


def feed_stream(spark: SparkSession, feed: str, symbols: list[str] | None = None, start: int = 0, splits: int = 1, **options: str) -> DataFrame:
    """SRC-4, SRC-5: the frames of a feed as a stream with ``value``, for ``streaming.news_stream``."""
    spark.dataSource.register(NewsFeed)
    return spark.readStream.format("news_feed").options(
        feed=feed, symbols=",".join(symbols or ["*"]), start=str(start), splits=str(splits), **options
    ).load()
