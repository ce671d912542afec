"""Structured Streaming jobs."""

from .memory import last_pairs, memory_stream, read_memory
from .news import ingest_frames, news_stream
from .progress import ProgressLog, counts_tap, read_progress

__all__ = ["ProgressLog", "counts_tap", "ingest_frames", "last_pairs", "memory_stream", "news_stream", "read_memory", "read_progress"]
