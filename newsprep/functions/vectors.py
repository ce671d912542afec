"""Vector expressions and the built-in hashing encoder (VEC-1, VEC-3)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ids import hash_bucket
from .text import as_column, words

VECTOR = T.ArrayType(T.FloatType())


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(c: Column | str) -> Column:
    return F.sqrt(dot(c, c))


def cosine(a: Column | str, b: Column | str) -> Column:
    """VEC-1: cosine similarity of two vectors in a row, rounded to six places; 0 for a zero vector."""
    lengths = norm(a) * norm(b)
    return F.round(F.when(lengths == 0, 0.0).otherwise(dot(a, b) / lengths), 6)


def word_buckets(c: Column | str, dim: int) -> Column:
    """The bucket of every word of a text, in order."""
    return F.transform(words(c), lambda w: hash_bucket(w, dim).cast("int"))


#: Counters of eight bytes held at once while a batch is encoded.
_COUNTERS = 1 << 18


def _counter(dim: int):
    rows_at_once = max(1, _COUNTERS // dim)

    def count_slice(buckets: pa.Array) -> np.ndarray:
        rows = len(buckets)
        lengths = buckets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(rows, dtype=np.int64), lengths)
        hits = buckets.flatten().to_numpy(zero_copy_only=False)
        return np.bincount(owner * dim + hits, minlength=rows * dim)

    def count(buckets: pa.Array) -> pa.Array:
        rows = len(buckets)
        counts = np.empty(rows * dim, np.float32)  # filled slice by slice, never copied
        for i in range(0, rows, rows_at_once):
            counts[i * dim:(i + rows_at_once) * dim] = count_slice(buckets.slice(i, rows_at_once))
        offsets = np.arange(0, (rows + 1) * dim, dim, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts))

    return F.arrow_udf(count, VECTOR)


def hash_vector(c: Column | str, dim: int = 384) -> Column:
    """VEC-3: word counts by hash bucket. Hashing runs in the JVM, counting on Arrow batches."""
    return _counter(dim)(word_buckets(c, dim))
