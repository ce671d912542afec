"""News to documents, documents to points (PRJ-3, PRJ-8, PRJ-9, MAP-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprep.functions.html import html_to_text
from newsprep.functions.ids import content_id
from newsprep.functions.text import clean_ascii
from newsprep.schemas import METADATA_FIELDS


def to_documents(news: DataFrame) -> DataFrame:
    """PRJ-3: the id hashes the raw content; headline, summary and content are cleaned, in that order.

    ``updated_at`` stays beside the metadata because it decides which write is last.
    """
    cleaned = news.withColumns({
        "doc_id": content_id("content"),
        "headline": clean_ascii("headline"),
        "summary": clean_ascii("summary"),
        "_body": clean_ascii(html_to_text("content")),
    })
    return cleaned.select(
        "doc_id",
        F.col("id").alias("article_id"),
        F.array("headline", "summary", "_body").alias("text"),
        F.struct(*METADATA_FIELDS).alias("metadata"),
        "updated_at",
    )


def payload(metadata: str = "metadata", chunk: str = "chunk") -> Column:
    """MAP-1: the metadata fields and the chunk's own text."""
    return F.struct(F.col(f"{metadata}.*"), F.col(chunk).alias("text"))


def to_points(chunks: DataFrame) -> DataFrame:
    """PRJ-8: one row per chunk with its hash id and payload; every chunk keeps its own text."""
    return chunks.withColumn("chunk_id", content_id("chunk")).withColumn("payload", payload()).drop("metadata")


def _unequal(ids: str, vectors: str, payloads: str) -> Column:
    return ~F.coalesce((F.size(ids) == F.size(vectors)) & (F.size(ids) == F.size(payloads)), F.lit(False))


def unequal(df: DataFrame, ids: str, vectors: str, payloads: str) -> DataFrame:
    """PRJ-9: the rows whose arrays differ in length, or are null: rejects, nothing is cut."""
    return df.where(_unequal(ids, vectors, payloads))


def zip_points(df: DataFrame, ids: str, vectors: str, payloads: str) -> DataFrame:
    """PRJ-9: parallel arrays of one length to rows; see ``unequal`` for the others."""
    zipped = F.arrays_zip(*[
        F.col(name).alias(alias) for name, alias in ((ids, "chunk_id"), (vectors, "vector"), (payloads, "payload"))
    ])
    others = [c for c in df.columns if c not in (ids, vectors, payloads)]
    return df.where(~_unequal(ids, vectors, payloads)).select(*others, F.inline(zipped).alias("chunk_id", "vector", "payload"))
