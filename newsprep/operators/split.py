"""Train and test splits (WIN-3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import carried_total

#: Keys that one task merges at most.
SELECTED = 10_000


def split_first_n(df: DataFrame, n: int, order_by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows in the order ``order_by``, which is unique and not null, and the rest.

    Only keys are read for it: the key of the n-th row is found, and every row is compared with it
    where it is read. Up to ``SELECTED`` keys each task selects its first ``n`` and those are
    merged; beyond, the keys are placed by ranges and positions.
    """
    keys, key = df.select(*order_by), F.struct(*order_by)
    if n <= SELECTED:
        head = keys.orderBy(*order_by).limit(n)
    else:
        head = carried_total(keys, order_by, F.lit(1), "_position").where(F.col("_position") < n)
    # No n-th key (n is 0) leaves every row in the second part.
    first = F.coalesce(key <= head.agg(F.max(key)).scalar(), F.lit(False))
    return df.where(first), df.where(~first)


def split_by_hash(df: DataFrame, key: str, fraction: float) -> tuple[DataFrame, DataFrame]:
    """A stable split by the whole 32-bit hash of a key; no order, no shuffle. Null keys go to the second part."""
    place = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    chosen = F.coalesce(place < F.lit(round(fraction * 2**32)), F.lit(False))
    return df.where(chosen), df.where(~chosen)
