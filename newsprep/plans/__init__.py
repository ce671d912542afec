"""Whole flows, composed from the operators."""

from .answering import answer_all, prompts, question_vectors, retrieve
from .dataset import build_examples, infer_all, prompt_table
from .ingest import news_chunks, news_points

__all__ = [
    "answer_all", "build_examples", "infer_all", "news_chunks", "news_points", "prompt_table",
    "prompts", "question_vectors", "retrieve",
]
