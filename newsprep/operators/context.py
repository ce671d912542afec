"""Context strings (AGG-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def context(matches: DataFrame, queries: DataFrame | None = None, field: str = "summary") -> DataFrame:
    """Match texts in rank order, each with a newline after it; ``query_id, context``.

    A question holds at most the ``k`` matches of the search, so its list is bounded. With
    ``queries`` given, a question without matches gets the empty string.
    """
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.coalesce(field, F.lit("")).alias("text"))))
    lines = F.transform(ranked, lambda m: F.concat(m["text"], F.lit("\n")))
    built = matches.groupBy("query_id").agg(F.array_join(lines, "").alias("context"))
    if queries is None:
        return built
    return queries.join(built, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
