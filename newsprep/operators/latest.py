"""Last write wins (WIN-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What makes a write the last one comes from the data, so replays and streams agree.
RECENCY = ("updated_at", "created_at", "article_id", "part", "pos")


def latest(df: DataFrame, key: str = "chunk_id", recency: tuple[str | Column, ...] = RECENCY) -> DataFrame:
    """One row per key, the most recent.

    The rank filter keeps one row per key in each task before the shuffle, so a key on a third of
    all rows sends one row per task.
    """
    order = [F.desc_nulls_last(c) if isinstance(c, str) else c.desc_nulls_last() for c in recency]
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")
