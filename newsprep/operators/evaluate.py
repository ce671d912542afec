"""Perplexity, sizes and usage (AGG-2..4, FLT-4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from newsprep.functions.tokens import MakeCount, count_tokens


def perplexity(df: DataFrame, nll_col: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG-2: ``exp`` of the mean negative log likelihood, overall or by group."""
    return df.groupBy(*by).agg(F.exp(F.avg(nll_col)).alias("perplexity"))


def count_rows(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """AGG-3: the same rows, counted on the way; ``observation.get["n"]`` after the first action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """AGG-3: number of rows by group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def usage_columns(
    prompt: str = "prompt", output: str = "answer", make_count: MakeCount | None = None
) -> dict[str, Column]:
    """AGG-4: lengths in characters, named so; with a tokenizer, counts of tokens as well."""

    def sizes_of(unit: str, asked: Column, new: Column) -> dict[str, Column]:
        return {f"prompt_{unit}": asked, f"total_{unit}": asked + new, f"actual_new_{unit}": new}

    def chars(name: str) -> Column:
        return F.coalesce(F.length(name), F.lit(0)).cast("bigint")

    columns = sizes_of("chars", chars(prompt), chars(output))
    if make_count is not None:
        columns |= sizes_of("tokens", count_tokens(prompt, make_count), count_tokens(output, make_count))
    return columns


def usage(log: DataFrame, by: Sequence[str] = ("project", "model")) -> DataFrame:
    """AGG-4: totals over a prompt log, in every unit the log has."""
    measured = [
        f"{what}_{unit}" for unit in ("chars", "tokens") for what in ("prompt", "total", "actual_new")
        if f"{what}_{unit}" in log.columns
    ]
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in measured])


def loggable(df: DataFrame, metadata: str = "metadata", log_prompt: bool = True) -> DataFrame:
    """FLT-4: rows that carry usage metadata; none when logging is off."""
    return df.where(F.col(metadata).isNotNull() & F.lit(log_prompt))
