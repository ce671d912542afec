"""Explicit schemas. Nothing in the library infers a schema from data."""

from pyspark.sql import types as T

NEWS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("headline", T.StringType(), False),
    T.StructField("summary", T.StringType(), False),
    T.StructField("author", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("updated_at", T.TimestampType(), False),
    T.StructField("url", T.StringType(), True),
    T.StructField("content", T.StringType(), False),
    T.StructField("symbols", T.ArrayType(T.StringType()), False),
    T.StructField("source", T.StringType(), False),
])

#: One element of a landed message. Scalars stay text so that a bad value is seen, not lost.
MESSAGE_SCHEMA = T.StructType([
    T.StructField("T", T.StringType()),
    T.StructField("msg", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("headline", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("symbols", T.ArrayType(T.StringType())),
    T.StructField("source", T.StringType()),
])

METADATA_FIELDS = ("headline", "summary", "url", "symbols", "author", "created_at")

QA_SCHEMA = T.StructType([
    T.StructField("about_me", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("chat_history", T.StringType()),
])

SAMPLE_FIELDS = ("user_context", "news_context", "chat_history", "question", "answer")

LOG_FIELDS = (
    "project", "prompt", "output", "variables", "prompt_chars", "total_chars",
    "actual_new_chars", "model", "peft_model", "duration_ms",
)
