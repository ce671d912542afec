"""Prompt templates (STR-10..12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column

# Markers that frame the sections of the prompts.
OPEN, CLOSE, END = "[INST] ", " [/INST]", " </s>"
ABOUT, NEWS, HISTORY = "\n\n### ABOUT ME: ", "\n\n### LATEST NEWS: ", "\n\n### CHAT HISTORY: "
QUESTION, RESPONSE = "\n\n### QUESTION: ", "\n\n### RESPONSE: "
TEACHER_ABOUT, TEACHER_CONTEXT = "\n\n# ABOUT ME\n", "\n\n# CONTEXT\n"

INSTRUCTION = (
    "You answer questions about finance. Use the user's description and the news below, "
    "and give the reason for your answer."
)
TEACHER_INSTRUCTION = "You know the stock and crypto markets well. Advise me, given who I am and what happened."
TEACHER_CLOSING = "\n\nGive one piece of advice in less than 100 tokens and say which part of the context supports it.\n"


def _text(c: Column | str) -> Column:
    return F.coalesce(as_column(c), F.lit(""))


def inference_text(
    user_context: Column | str,
    news_context: Column | str,
    question: Column | str,
    chat_history: Column | str | None = None,
    instruction: str = INSTRUCTION,
) -> Column:
    """STR-11: stops after the question. A history section is added only when given."""
    parts = [
        F.lit(OPEN + instruction + ABOUT), _text(user_context),
        F.lit(NEWS), _text(news_context),
    ]
    if chat_history is not None:
        parts += [F.lit(HISTORY), _text(chat_history)]
    return F.concat(*parts, F.lit(QUESTION), _text(question), F.lit(CLOSE))


def training_text(
    user_context: Column | str,
    news_context: Column | str,
    question: Column | str,
    answer: Column | str,
    instruction: str = INSTRUCTION,
) -> Column:
    """STR-10: the inference prompt followed by the answer and an end mark."""
    asked = inference_text(user_context, news_context, question, instruction=instruction)
    return F.concat(asked, F.lit(RESPONSE), _text(answer), F.lit(END))


def teacher_text(
    about_me: Column | str,
    context: Column | str,
    instruction: str = TEACHER_INSTRUCTION,
    closing: str = TEACHER_CLOSING,
) -> Column:
    """STR-12: about-me and context only."""
    return F.concat(
        F.lit("\n" + instruction + TEACHER_ABOUT), _text(about_me),
        F.lit(TEACHER_CONTEXT), _text(context), F.lit(closing),
    )
