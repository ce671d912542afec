"""Token counts (UDF-4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import as_column, words

#: Built once per Python worker; returns a function from texts to token counts.
MakeCount = Callable[[], Callable[[Sequence[str]], Sequence[int]]]


def count_tokens(c: Column | str, make_count: MakeCount | None = None) -> Column:
    """Tokens of a text: words by default, or what the given tokenizer says, in Arrow batches."""
    if make_count is None:
        return F.coalesce(F.size(words(c)), F.lit(0)).cast("bigint")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = make_count()
        for texts in batches:
            yield pa.array(count([t or "" for t in texts.to_pylist()]), pa.int64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.LongType())(as_column(c))
