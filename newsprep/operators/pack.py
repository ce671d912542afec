"""Packing samples into fixed-length sequences (WIN-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprep.session import materialize

from .ordering import carried_total


def pack(df: DataFrame, length: int, id_col: str = "sample_id", tokens: str = "tokens", separator: int = 0) -> DataFrame:
    """Lay samples end to end in id order and cut every ``length`` tokens.

    One row per sample and sequence it touches: ``seq_id``, the id, ``token_from`` and
    ``token_to`` within the sample. ``separator`` tokens follow each sample and count as its own.
    A sample without tokens touches no sequence. Joining the rows back to the texts is left to the
    caller, so that only ids and counts are ordered.
    """
    # Kept, so that a count computed from text is not computed again to sample the ranges.
    sized = materialize(df.select(id_col, (F.col(tokens) + F.lit(separator)).cast("bigint").alias("_n")))
    placed = carried_total(sized, [id_col], F.col("_n")).where(F.col("_n") > 0)
    first = F.call_function("div", F.col("before"), F.lit(length))
    final = F.call_function("div", F.col("before") + F.col("_n") - 1, F.lit(length))
    start = F.col("seq_id") * length
    return placed.withColumn("seq_id", F.explode(F.sequence(first, final))).select(
        "seq_id", id_col,
        F.greatest(start - F.col("before"), F.lit(0)).alias("token_from"),
        F.least(start + length - F.col("before"), F.col("_n")).alias("token_to"),
    )
