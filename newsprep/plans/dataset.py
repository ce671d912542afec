"""Building and running question-answer sets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from newsprep.operators.generate import MakeGenerate, generate, label
from newsprep.operators.qa import (
    clean_samples, inference_prompt, split_question, teacher_prompt, to_samples, training_prompt,
)


def build_examples(queries: DataFrame, make_generate_fn: MakeGenerate, batch_size: int = 16) -> DataFrame:
    """Teacher prompt, teacher answer, then the question is split off ``about_me``."""
    labelled = label(teacher_prompt(queries), make_generate_fn, batch_size).drop("prompt", "duration_ms")
    return split_question(labelled)


def prompt_table(raw: DataFrame, mode: str = "training") -> DataFrame:
    """Raw examples to cleaned prompt and payload."""
    samples = clean_samples(to_samples(raw, mode))
    return training_prompt(samples) if mode == "training" else inference_prompt(samples)


def infer_all(raw: DataFrame, make_generate_fn: MakeGenerate, batch_size: int = 16) -> DataFrame:
    """Inference prompts of raw examples with their answers."""
    return generate(prompt_table(raw, "inference"), make_generate_fn, batch_size)
