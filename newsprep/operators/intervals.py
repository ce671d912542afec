"""Time ranges (SRC-1, SRC-2, FLT-1, SRT-1)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprep.functions.text import as_column


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _bound(at: datetime | Column | str) -> Column:
    return F.lit(at).cast("timestamp") if isinstance(at, (datetime, str)) else at


def intervals(spark: SparkSession, start: datetime | str, end: datetime | str, n: int) -> DataFrame:
    """SRC-2: ``n`` half-open intervals covering ``[start, end)``; integer arithmetic, no gap, no overlap."""
    span = spark.range(1).select(F.lit(start).cast("timestamp").alias("lo"), F.lit(end).cast("timestamp").alias("hi"))
    return split_span(span, n)


def split_span(span: DataFrame, n: int) -> DataFrame:
    """The intervals of every ``(lo, hi)`` row of ``span``."""
    # The first microsecond t of interval i is the smallest with (t - lo) * n >= i * (hi - lo).
    edge = "timestamp_micros(unix_micros(lo) + ({i} * (unix_micros(hi) - unix_micros(lo)) + {n} - 1) div {n})"
    return (
        span.withColumn("interval", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
        .withColumn("interval_start", F.expr(edge.format(i="interval", n=n)))
        .withColumn("interval_end", F.expr(edge.format(i="(interval + 1)", n=n)))
        .drop("lo", "hi")
    )


def interval_id(ts: Column | str, start: datetime | Column | str, end: datetime | Column | str, n: int) -> Column:
    """The interval a time stamp of ``[start, end)`` falls in; agrees with ``intervals``."""
    offset = _micros(as_column(ts)) - _micros(_bound(start))
    width = _micros(_bound(end)) - _micros(_bound(start))
    return F.call_function("div", offset * F.lit(n), width).cast("bigint")


def in_range(ts: Column | str, start: datetime | Column | str, end: datetime | Column | str) -> Column:
    """FLT-1: half-open range test that reaches the file scan as a pushed filter."""
    return (as_column(ts) >= _bound(start)) & (as_column(ts) < _bound(end))


def backfill(
    df: DataFrame,
    start: datetime | str,
    end: datetime | str,
    n: int = 1,
    ts_col: str = "created_at",
    id_col: str = "id",
) -> DataFrame:
    """SRC-1, SRT-1: rows of ``[start, end)`` with their interval, in time order within a partition.

    No shuffle: the interval is arithmetic on the row, not a range join.
    """
    return (
        df.where(in_range(ts_col, start, end))
        .withColumn("interval", interval_id(ts_col, start, end, n))
        .sortWithinPartitions("interval", ts_col, id_col)
    )
