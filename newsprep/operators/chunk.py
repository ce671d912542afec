"""Token-budget chunking (STR-13, ARR-1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsprep.functions.text import as_column, single_spaced, words
from newsprep.functions.tokens import MakeCount


def word_chunks(c: Column | str, max_tokens: int) -> Column:
    """Chunks of at most ``max_tokens`` words; empty text has none.

    One pass of a pattern over the text: cutting an array of words chunk by chunk would copy the
    array each time. Possessive quantifiers keep the match free of recursion.
    """
    run = f"(?:[^ ]++ ){{0,{max_tokens - 1}}}+[^ ]++"
    return F.regexp_extract_all(single_spaced(c), F.lit(run), F.lit(0))


def _pieces(word: str, size: int, budget: int, count: Callable[[list[str]], list[int]]) -> list[str]:
    """A word over the budget in cuts of characters; a piece that is still over it is cut again.

    One character alone stays whole whatever it costs.
    """
    step = max(1, min(len(word) - 1, len(word) * budget // size))
    pieces = [word[i:i + step] for i in range(0, len(word), step)]
    return [
        part for piece, n in zip(pieces, count(pieces), strict=True)
        for part in (_pieces(piece, n, budget, count) if n > budget and len(piece) > 1 else [piece])
    ]


def _fill(parts: list[str], sizes: list[int], budget: int, count: Callable[[list[str]], list[int]]) -> list[dict]:
    """Greedy fill: a chunk takes words until the next one would pass the budget.

    The words between two that are over the budget are cut by their running total: a chunk ends
    where the total passes that of its start by the budget, found by bisection. So a text costs one
    step per chunk, not per word.
    """
    n = np.asarray(sizes, np.int64)
    total = np.cumsum(n)
    over = np.flatnonzero(n > budget)
    chunks: list[dict] = []
    at = 0
    for stop in [*over.tolist(), len(parts)]:
        while at < stop:
            before = int(total[at - 1]) if at else 0
            end = min(int(np.searchsorted(total, before + budget, "right")), stop)
            chunks.append({"chunk": " ".join(parts[at:end]), "hard_split": False})
            at = end
        if stop < len(parts):
            chunks += [{"chunk": p, "hard_split": True} for p in _pieces(parts[stop], sizes[stop], budget, count)]
            at = stop + 1
    return chunks


def token_chunks(c: Column | str, max_tokens: int, make_count: MakeCount) -> Column:
    """Greedy chunks by a real tokenizer, in Arrow batches; a word over budget is split and flagged."""
    item = T.StructType([T.StructField("chunk", T.StringType()), T.StructField("hard_split", T.BooleanType())])
    arrow_item = pa.list_(pa.struct([("chunk", pa.string()), ("hard_split", pa.bool_())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = make_count()
        for texts in batches:
            rows = [parts or [] for parts in texts.to_pylist()]
            sizes = iter(count([word for parts in rows for word in parts]))
            yield pa.array(
                [_fill(parts, [next(sizes) for _ in parts], max_tokens, count) for parts in rows], arrow_item
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.ArrayType(item))(words(as_column(c)))


def chunk(df: DataFrame, max_tokens: int, make_count: MakeCount | None = None, text: str = "text") -> DataFrame:
    """STR-13, ARR-1: the parts of ``text`` (an array) to one row per chunk, with ``part`` and ``pos``."""
    others = [c for c in df.columns if c != text]
    # The outer form keeps the optimizer from testing the array's size below the explode, which
    # would clean every text a second time.
    parts = df.select(*others, F.posexplode_outer(text).alias("part", "_part_text")).where("part is not null")
    if make_count is None:
        return parts.select(
            *others, "part", F.posexplode(word_chunks("_part_text", max_tokens)).alias("pos", "chunk"),
            F.lit(False).alias("hard_split"),
        )
    exploded = parts.select(
        *others, "part", F.posexplode(token_chunks("_part_text", max_tokens, make_count)).alias("pos", "_item")
    )
    return exploded.select(*others, "part", "pos", "_item.chunk", "_item.hard_split")
