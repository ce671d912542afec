"""Column functions: ``Column -> Column``, usable in batch and streaming queries alike."""

from .dates import iso_z, parse_day, parse_rfc3339
from .html import html_to_text
from .ids import content_id, hash_bucket
from .prompts import inference_text, teacher_text, training_text
from .text import (
    clean, clean_ascii, clean_extra_whitespace, clean_fields, clean_question, clean_sample,
    cut, group_paragraphs, replace_quotes, strip_non_ascii, words,
)
from .tokens import count_tokens
from .vectors import cosine, dot, hash_vector, norm, word_buckets

__all__ = [
    "clean", "clean_ascii", "clean_extra_whitespace", "clean_fields", "clean_question",
    "clean_sample", "content_id", "cosine", "count_tokens", "cut", "dot", "group_paragraphs",
    "hash_bucket", "hash_vector", "html_to_text", "inference_text", "iso_z", "norm",
    "parse_day", "parse_rfc3339", "replace_quotes", "strip_non_ascii", "teacher_text",
    "training_text", "word_buckets", "words",
]
