"""Symbol subscription and spreading (SRC-5, SRC-6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprep.functions.ids import hash_bucket


def by_symbols(df: DataFrame, symbols: Sequence[str], col: str = "symbols") -> DataFrame:
    """SRC-5: rows that carry any of the symbols; ``*`` means all rows."""
    if "*" in symbols:
        return df
    return df.where(F.arrays_overlap(F.col(col), F.array(*[F.lit(s) for s in symbols])))


def spread_by_symbol(
    df: DataFrame,
    n: int,
    col: str = "symbols",
    id_col: str = "id",
    salts: int = 16,
    partitions: int | None = None,
) -> DataFrame:
    """SRC-6: one row per article and symbol, with the worker the symbol belongs to.

    ``worker`` is a hash of the symbol, so none is dropped. Rows are laid out by worker and a
    salt taken from the row id, so that a symbol on a third of all rows still spreads over
    ``salts`` tasks.
    """
    rows = (
        df.withColumn("symbol", F.explode(col))
        .withColumn("worker", hash_bucket("symbol", n))
        .withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(salts)))
    )
    return rows.repartition(partitions or n * salts, "worker", "_salt").drop("_salt")
