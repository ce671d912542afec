"""Bulk question answering (UDF-5): retrieve, build prompts, generate, log."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprep.functions.text import clean_question
from newsprep.operators.context import context
from newsprep.operators.encode import MakePredict
from newsprep.operators.generate import MakeGenerate, generate
from newsprep.operators.history import history
from newsprep.operators.qa import clean_samples, inference_prompt
from newsprep.operators.search import search, with_payload
from newsprep.plans.ingest import encode_text
from newsprep.session import work_dir
from newsprep.sources.files import append_log, prompt_log


def question_vectors(
    questions: DataFrame, make_predict_fn: MakePredict | None = None, dim: int = 384, max_chars: int | None = None
) -> DataFrame:
    """STR-7, STR-8, UDF-1: ``query_id, vector`` of every question that could be embedded."""
    asked = questions.select("query_id", clean_question("question", max_chars).alias("_asked"))
    return encode_text(asked, make_predict_fn, dim, "_asked").where(F.size("vector") == dim).select("query_id", "vector")


def retrieve(
    questions: DataFrame,
    points: DataFrame,
    k: int = 1,
    make_predict_fn: MakePredict | None = None,
    dim: int = 384,
    max_chars: int | None = None,
    context_field: str = "summary",
    since: str | None = None,
    as_of: datetime | None = None,
    **blocks: int,
) -> DataFrame:
    """Questions with their context: the summaries (or texts) of the best ``k`` points."""
    vectors = question_vectors(questions, make_predict_fn, dim, max_chars)
    matches = search(vectors, points, k, since, as_of, **blocks)
    return context(with_payload(matches, points, context_field), questions, context_field)


def prompts(
    questions: DataFrame,
    turns: DataFrame | None = None,
    history_pairs: int = 3,
    include_history: bool = False,
    **options,
) -> DataFrame:
    """Questions with ``context`` to prompt and payload. ``turns`` adds the history of ``conv_id``."""
    if turns is not None:
        past = history(turns, history_pairs).select("conv_id", "chat_history")
        questions = questions.join(past, "conv_id", "left")
    else:
        questions = questions.withColumn("chat_history", F.lit(""))
    others = [c for c in questions.columns if c not in ("about_me", "context", "chat_history", "question")]
    samples = questions.select(
        *others, F.col("about_me").alias("user_context"), F.col("context").alias("news_context"),
        F.coalesce("chat_history", F.lit("")).alias("chat_history"), "question",
    )
    cleaned = clean_samples(samples.withColumn("answer", F.lit(""))).drop("answer")
    return inference_prompt(cleaned, include_history, **options)


def answer_all(
    questions: DataFrame,
    points: DataFrame,
    make_generate_fn: MakeGenerate,
    turns: DataFrame | None = None,
    k: int = 1,
    include_history: bool = False,
    batch_size: int = 16,
    instruction: str | None = None,
    log_path: str | None = None,
    run_id: str | None = None,
    project: str = "answers",
    model: str | None = None,
    **retrieval,
) -> DataFrame:
    """Answers for a table of questions (``query_id, about_me, question`` and ``conv_id`` with ``turns``).

    ``instruction`` opens every prompt. With ``log_path`` the answers are computed once, when this is
    called, kept as a table, and logged as one batch of ``run_id``: the same run again replaces its log (SNK-4).
    """
    options = {} if instruction is None else {"instruction": instruction}
    asked = prompts(retrieve(questions, points, k, **retrieval), turns, include_history=include_history, **options)
    answers = generate(asked, make_generate_fn, batch_size)
    if log_path is None:
        return answers
    path = work_dir(answers.sparkSession, "answers")
    answers.write.parquet(path)
    kept = answers.sparkSession.read.schema(answers.schema).parquet(path)
    append_log(prompt_log(kept, project, model), log_path, run_id or uuid.uuid4().hex)
    return kept
