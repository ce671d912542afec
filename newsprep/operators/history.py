"""Chat history (WIN-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# How a pair is written out.
HUMAN, AI = "Human: ", "AI: "


def _levels(turns: DataFrame, width: int) -> int:
    """How many rounds of segments it takes until one segment spans every turn number."""
    span = turns.agg((F.max("turn") - F.min("turn")).alias("span")).first()["span"] or 0
    levels = 1
    while span >= width ** levels:
        levels += 1
    return levels


def _next(rows: DataFrame, keys: list[Column | str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy("turn")
    return rows.withColumns({"_role": F.lead(F.coalesce("role", F.lit(""))).over(w), "_text": F.lead("text").over(w), "_place": F.row_number().over(w)})


def pairs(turns: DataFrame, user: str = "user", assistant: str = "assistant", width: int = 4096) -> DataFrame:
    """Question/answer pairs: a user turn directly followed by an assistant turn.

    A conversation may be any share of the table, so it is not sorted in one task. Its turns are
    cut into segments of ``width`` turn numbers and paired there. Only the ends of the segments go
    on to the next round, where ``width`` segments form one, until one segment is left. Short
    conversations take one round: a single shuffle by conversation.

    ``turn`` is an integer and unique within a conversation.
    """
    levels = _levels(turns, width)
    low = turns.select("conv_id", "turn", "role", "text").withColumn("_open", F.lit(True))
    found = None
    for level in range(1, levels + 1):
        last = level == levels
        segment = F.floor(F.col("turn") / F.lit(width ** level))
        rows = _next(low, ["conv_id"] if last else ["conv_id", segment])
        here = rows.where(
            F.col("_open") & (F.col("role") == user) & (F.col("_role") == assistant)
        ).select("conv_id", "turn", F.col("text").alias("question"), F.col("_text").alias("answer"))
        found = here if found is None else found.unionByName(here)
        if not last:
            # A first row can close a pair; a last row can open one, if it is a question.
            first, ends = F.col("_place") == 1, F.col("_role").isNull()
            opens = F.col("_open") & ends & (F.col("role") == user)
            low = rows.where(first | opens).select("conv_id", "turn", "role", "text", opens.alias("_open"))
    return found


def chat_lines(pairs: str) -> Column:
    """An array of pairs written out, one after the other."""
    lines = F.transform(F.col(pairs), lambda p: F.concat(F.lit(HUMAN), p["question"], F.lit("\n" + AI), p["answer"]))
    return F.array_join(lines, "\n")


def history(turns: DataFrame, k: int = 3, **options) -> DataFrame:
    """The last ``k`` pairs of each conversation, oldest first: ``conv_id, pairs, chat_history``.

    Conversations without a pair are absent. The rank filter drops all but ``k`` pairs of a
    conversation in each task before the shuffle.
    """
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = pairs(turns, **options).withColumn("_rank", rank).where(F.col("_rank") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("turn", "question", "answer")))
    return kept.groupBy("conv_id").agg(ordered.alias("pairs")).withColumn("chat_history", chat_lines("pairs"))
