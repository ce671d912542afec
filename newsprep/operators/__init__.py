"""Table operators: ``DataFrame -> DataFrame``."""

from .chunk import chunk, token_chunks, word_chunks
from .context import context
from .documents import payload, to_documents, to_points, unequal, zip_points
from .encode import embed, hash_encode, split_failures, with_state
from .evaluate import count_rows, loggable, perplexity, sizes, usage, usage_columns
from .generate import generate, label
from .history import history, pairs
from .intervals import backfill, in_range, interval_id, intervals, split_span
from .latest import latest
from .ordering import carried_total, running_total
from .pack import pack
from .parse import explode_messages, parse_messages, validate
from .qa import (
    clean_samples, inference_prompt, split_question, teacher_prompt, to_samples, training_prompt,
)
from .search import search, search_report, with_payload
from .split import split_by_hash, split_first_n
from .symbols import by_symbols, spread_by_symbol

__all__ = [
    "backfill", "by_symbols", "carried_total", "chunk", "clean_samples", "context", "count_rows", "embed",
    "explode_messages", "generate", "hash_encode", "history", "in_range", "inference_prompt",
    "interval_id", "intervals", "label", "latest", "loggable", "pack", "pairs", "parse_messages",
    "payload", "perplexity", "running_total", "search", "search_report", "sizes", "split_by_hash",
    "split_failures", "split_first_n", "split_question", "split_span", "spread_by_symbol",
    "teacher_prompt", "to_documents", "to_points", "to_samples", "token_chunks",
    "training_prompt", "usage", "usage_columns", "validate", "with_payload", "with_state", "word_chunks",
    "unequal", "zip_points",
]
