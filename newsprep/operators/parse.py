"""Landed messages to typed news rows and rejects (PRJ-1, PRJ-2, JSN-1, DT-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsprep.functions.dates import parse_rfc3339
from newsprep.schemas import MESSAGE_SCHEMA, NEWS_SCHEMA

# Message types that carry no article.
CONTROL = ("success", "subscription")
#: A message of this type reports a failure of the feed; it is refused, so that it is seen.
FAILURE = "error"
REQUIRED = ("id", "headline", "summary", "author", "created_at", "updated_at", "content", "symbols", "source")


def explode_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """PRJ-1, JSN-1: one row per message of a frame. An unreadable frame gives one row, an empty one none.

    The frame's text is replaced by ``raw``, which is kept for unreadable frames only, so that a
    frame is not copied to each of its messages.
    """
    others = [c for c in df.columns if c != value]
    frames = df.withColumn("_messages", F.from_json(value, T.ArrayType(MESSAGE_SCHEMA)))
    frames = frames.select(*others, "_messages", F.when(F.col("_messages").isNull(), F.col(value)).alias("raw"))
    exploded = frames.select(*others, "raw", F.explode_outer("_messages").alias("message"))
    return exploded.where(F.col("message").isNotNull() | F.col("raw").isNotNull())


def reject_reason(m: str = "message") -> Column:
    """Why a message is not an article; null for a good one and for a control frame."""

    def field(name: str) -> Column:
        return F.col(f"{m}.{name}")

    reasons = F.when(F.col(m).isNull(), "invalid json").when(field("T").isin(*CONTROL), None).when(field("T") == FAILURE, "feed error")
    for name in REQUIRED:
        reasons = reasons.when(field(name).isNull(), f"missing {name}")
    reasons = reasons.when(F.exists(field("symbols"), lambda s: s.isNull()), "null symbol")
    reasons = reasons.when(field("id").try_cast("bigint").isNull(), "bad id")
    for name in ("created_at", "updated_at"):
        reasons = reasons.when(parse_rfc3339(field(name)).isNull(), f"bad {name}")
    return reasons


def validate(messages: DataFrame) -> DataFrame:
    """PRJ-2: adds ``reason`` and ``is_control`` to exploded messages."""
    return messages.withColumns({
        "reason": reject_reason(),
        "is_control": F.coalesce(F.col("message.T").isin(*CONTROL), F.lit(False)),
    })


def news_columns(m: str = "message") -> list[Column]:
    """The typed fields of a news row."""
    typed = {
        "id": F.col(f"{m}.id").try_cast("bigint"),
        "created_at": parse_rfc3339(f"{m}.created_at"),
        "updated_at": parse_rfc3339(f"{m}.updated_at"),
    }
    return [typed.get(f.name, F.col(f"{m}.{f.name}")).alias(f.name) for f in NEWS_SCHEMA]


def good_rows(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reason").isNull() & ~F.col("is_control")).select(*news_columns())


def reject_rows(validated: DataFrame) -> DataFrame:
    """What was refused, with the raw text it came from."""
    raw = F.coalesce(F.to_json("message"), "raw")
    return validated.where(F.col("reason").isNotNull()).select("reason", raw.alias("raw"))


def parse_messages(df: DataFrame, mode: str = "permissive") -> tuple[DataFrame, DataFrame]:
    """Good news rows and rejects. ``failfast`` raises on the first bad message instead."""
    validated = validate(explode_messages(df))
    if mode == "failfast":
        stop = F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.lit("bad message: "), "reason")))
        validated = validated.where(stop.isNull())
    elif mode != "permissive":
        raise ValueError(f"unknown mode {mode!r}")
    return good_rows(validated), reject_rows(validated)
