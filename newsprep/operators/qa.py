"""Question-answer samples (PRJ-4..7, STR-9..12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprep.functions.prompts import inference_text, teacher_text, training_text
from newsprep.functions.text import clean_fields
from newsprep.schemas import SAMPLE_FIELDS


def to_samples(df: DataFrame, mode: str = "training") -> DataFrame:
    """PRJ-4: raw keys to sample names. History defaults to empty; the answer is kept in training only."""
    if mode not in ("training", "inference"):
        raise ValueError(f"unknown mode {mode!r}")
    known = {"about_me": "user_context", "context": "news_context", "question": "question"}
    others = [c for c in df.columns if c not in (*known, "chat_history", "response")]
    history = F.coalesce("chat_history", F.lit("")) if "chat_history" in df.columns else F.lit("")
    answer = F.col("response") if mode == "training" else F.lit("")
    named = {alias: F.coalesce(name, F.lit("")) for name, alias in known.items()}
    named |= {"chat_history": history, "answer": F.coalesce(answer, F.lit(""))}
    return df.select(*others, *[named[f].alias(f) for f in SAMPLE_FIELDS])


def clean_samples(df: DataFrame) -> DataFrame:
    """STR-9 on the five fields of a sample."""
    return clean_fields(df, SAMPLE_FIELDS)


def _with_prompt(df: DataFrame, prompt) -> DataFrame:
    """PRJ-5: of the sample fields only the prompt and the payload stay."""
    others = [c for c in df.columns if c not in SAMPLE_FIELDS]
    fields = [c for c in SAMPLE_FIELDS if c in df.columns]
    return df.select(*others, prompt.alias("prompt"), F.struct(*fields).alias("payload"))


def training_prompt(df: DataFrame, **options) -> DataFrame:
    """STR-10, PRJ-5."""
    return _with_prompt(df, training_text("user_context", "news_context", "question", "answer", **options))


def inference_prompt(df: DataFrame, include_history: bool = False, **options) -> DataFrame:
    """STR-11, PRJ-5. The history is cleaned and carried, but enters the prompt only on request."""
    history = F.col("chat_history") if include_history else None
    return _with_prompt(df, inference_text("user_context", "news_context", "question", history, **options))


def teacher_prompt(df: DataFrame, **options) -> DataFrame:
    """STR-12: built from the ``about_me`` that still holds the question."""
    return df.withColumn("prompt", teacher_text("about_me", "context", **options))


def split_question(df: DataFrame) -> DataFrame:
    """PRJ-6: the last line of ``about_me`` becomes ``question``; the rest stays."""
    lines = F.split("about_me", "\n")
    return df.withColumns({
        "about_me": F.array_join(F.slice(lines, F.lit(1), F.size(lines) - 1), "\n"),
        "question": F.element_at(lines, -1),
    })
