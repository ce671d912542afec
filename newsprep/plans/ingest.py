"""News rows to collection points (STM-2): one graph for backfill and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprep.functions.tokens import MakeCount
from newsprep.operators.chunk import chunk
from newsprep.operators.documents import to_documents, to_points
from newsprep.operators.encode import MakePredict, embed, hash_encode
from newsprep.sources.collection import latest_points, latest_points_kept


def news_chunks(news: DataFrame, max_tokens: int = 384, make_count: MakeCount | None = None) -> DataFrame:
    """Clean, chunk, hash: one row per chunk, with payload, before embedding."""
    return to_points(chunk(to_documents(news), max_tokens, make_count))


def encode_text(df: DataFrame, make_predict_fn: MakePredict | None, dim: int, text: str) -> DataFrame:
    """The user's encoder, or the built-in one."""
    if make_predict_fn is None:
        return hash_encode(df, dim, text).withColumn("error", F.lit(None).cast("string"))
    return embed(df, make_predict_fn, text=text)


def news_points(
    news: DataFrame,
    make_predict_fn: MakePredict | None = None,
    dim: int = 384,
    max_tokens: int = 384,
    make_count: MakeCount | None = None,
    dedup: bool = True,
    folder: str | None = None,
) -> DataFrame:
    """Points ready for ``upsert``. ``dedup`` embeds equal chunks once; batch input only.

    With ``folder``, a new one, the chunks are kept there to find the equal ones, and no whole chunk is shuffled. The points read
    from it; once they are written it can go.
    """
    chunks = news_chunks(news, max_tokens, make_count)
    if dedup and folder is None:
        chunks = latest_points(chunks)
    elif dedup:  # the payload holds the text
        chunks = latest_points_kept(chunks.drop("chunk"), folder).withColumn("chunk", F.col("payload.text"))
    return encode_text(chunks, make_predict_fn, dim, "chunk")
