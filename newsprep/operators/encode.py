"""Embedding (UDF-1, VEC-2, VEC-3, FLT-3)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsprep.functions.vectors import VECTOR, hash_vector
from newsprep.session import work_dir

#: Built once per Python worker; returns a function from an array of texts to one vector per
#: text. Pooling (the first token of the encoder output, say) is part of that function.
MakePredict = Callable[[], Callable[[np.ndarray], np.ndarray]]

_RESULT = T.StructType([T.StructField("vector", VECTOR), T.StructField("error", T.StringType())])
_ARROW_RESULT = pa.struct([("vector", pa.list_(pa.float32())), ("error", pa.string())])


def _predict_rows(predict, texts: list[str]) -> list[dict]:
    """One call for the batch; if it fails, one for each half, so that few calls find the bad rows."""
    try:
        vectors = list(predict(np.array(texts, dtype=object)))
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
        return [{"vector": np.asarray(v, dtype=np.float32), "error": None} for v in vectors]
    except Exception as failure:
        if len(texts) == 1:
            return [{"vector": [], "error": f"{type(failure).__name__}: {failure}"}]
        half = len(texts) // 2
        return _predict_rows(predict, texts[:half]) + _predict_rows(predict, texts[half:])


def embed(df: DataFrame, make_predict_fn: MakePredict, batch_size: int = 256, text: str = "chunk") -> DataFrame:
    """UDF-1: adds ``vector`` and ``error``; a text the model refuses gets an empty vector, a null text none."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = make_predict_fn()
        for texts in batches:
            values = [t for t in texts.to_pylist() if t is not None]
            found: list[dict] = []
            for start in range(0, len(values), batch_size):
                found += _predict_rows(predict, values[start:start + batch_size])
            rest = iter(found)
            rows = [next(rest) if known else {"vector": None, "error": "no text"} for known in texts.is_valid().to_pylist()]
            yield pa.array(rows, _ARROW_RESULT)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    model = F.arrow_udf(run, _RESULT).asNondeterministic()
    return df.withColumn("_embedded", model(text)).select(
        *df.columns, "_embedded.vector", "_embedded.error"
    )


def hash_encode(df: DataFrame, dim: int = 384, text: str = "chunk", vector: str = "vector") -> DataFrame:
    """VEC-3: the built-in encoder, word counts by hash bucket."""
    return df.withColumn(vector, hash_vector(text, dim))


def split_failures(df: DataFrame, dim: int, vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """FLT-3: rows whose vector has the right size, and the rest."""
    fits = F.coalesce(F.size(vector) == dim, F.lit(False))
    return df.where(fits), df.where(~fits)


def with_state(df: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """FLT-3: ``state``, ``ok`` where the vector has the right size and else ``failed``, on rows that are kept as a table.

    The model has run once when this returns, however often the good and the failed rows are read.
    """
    fits = F.coalesce(F.size(vector) == dim, F.lit(False))
    path = work_dir(df.sparkSession, "embedded")
    df.withColumn("state", F.when(fits, "ok").otherwise("failed")).write.parquet(path)
    return df.sparkSession.read.parquet(path)
