"""Exact top-k search: every query scatters its weighted postings into dense score arrays.

The query rows are written in blocks to the shared folder. A task holds a bounded chunk of
candidates as postings, one list per component, and takes block after block: term by term it adds
query weight times posting weight to an array with one score per candidate, then selects the best
``k`` by partition. The selections of all chunks are merged per query. Candidates are neither
shuffled nor copied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsprep.session import work_dir

from .common import batch

#: Candidates that a task scores at a time, and query rows that it holds at a time.
CHUNK, BLOCK = 1 << 15, 4096

RESULT = pa.schema([("query_id", pa.int64()), ("version", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: float = 256.0) -> DataFrame:
    """``vec_id, terms``: whole numbers; rows without id, without vector or with a null or non-finite component are left out."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & finite).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("bigint")).alias("terms")
    )


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, component and value of every entry that is not zero."""
    lengths = column.value_lengths().to_numpy()
    values = column.flatten().to_numpy()
    rows = np.repeat(np.arange(len(lengths)), lengths)
    terms = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = values != 0
    return rows[some], terms[some], values[some]


def postings(column: pa.Array) -> dict[int, tuple[np.ndarray | slice, np.ndarray]]:
    """For every component the rows that hold it and their weights; a list of all rows is kept as a slice."""
    rows, terms, values = _flat(column)
    order = np.argsort(terms, kind="stable")
    rows, terms, values = rows[order], terms[order], values[order]
    names, starts = np.unique(terms, return_index=True)
    lists = {}
    for t, a, b in zip(names.tolist(), starts, [*starts[1:], len(terms)], strict=True):
        if 2 * (b - a) > len(column):  # most rows: a full column, zeros included, adds faster than it scatters
            full = np.zeros(len(column), np.int64)
            full[rows[a:b]] = values[a:b]
            lists[t] = (slice(None), full)
        else:
            lists[t] = (rows[a:b], values[a:b])
    return lists


def _best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the ``k`` best, ties to the smaller id, without the query's own row."""
    k = min(k + int((ids == own).sum()), len(ids))
    if k == 0:
        return np.empty(0, np.int64)
    least = np.partition(scores, len(ids) - k)[len(ids) - k]
    at = np.flatnonzero(scores >= least)
    at = at[ids[at] != own]
    return at[np.lexsort((ids[at], -scores[at]))]


def _score(ids: np.ndarray, column: pa.Array, blocks: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    lists = postings(column)
    peak = max((int(np.abs(w).max()) for _, w in lists.values()), default=0)
    for block in blocks:
        rows, terms, values = _flat(block.column("terms"))
        bounds = np.searchsorted(rows, np.arange(len(block) + 1))
        small = peak * int(np.abs(values).max(initial=0)) * max(1, len(lists)) < 2**31
        kind = np.int32 if small else np.int64
        cast = {t: (at, w.astype(kind)) for t, (at, w) in lists.items()}
        scores, part = np.zeros(len(ids), kind), np.empty(len(ids), kind)
        out = [[], [], [], []]
        for q, (own, version) in enumerate(zip(block.column("vec_id").to_pylist(), block.column("version").to_pylist(), strict=True)):
            scores[:] = 0
            for t, w in zip(terms[bounds[q] : bounds[q + 1]].tolist(), values[bounds[q] : bounds[q + 1]], strict=True):
                if t in cast:
                    at, weights = cast[t]
                    if isinstance(at, slice):
                        np.multiply(weights, kind(w), out=part)
                        scores += part
                    else:
                        scores[at] += weights * kind(w)
            best = _best(ids, scores, own, k)[:k]
            for column_, value in zip(out, ([own] * len(best), [version] * len(best), ids[best].tolist(), scores[best].tolist()), strict=True):
                column_ += value
        yield batch(RESULT, out)


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of every query row among the rows of ``df``.

    Ties go to the smaller id; all candidates if there are fewer than ``k``. A row with the query's
    id is its own row and no candidate. Vectors of unequal length compare in the components that
    both have. Query rows that agree in id and vector are answered once; with the same id and
    other vectors, each is answered. Empty tables give an empty result. Scores are 64-bit whole
    numbers. Other columns are ignored.
    """
    spark = df.sparkSession
    path = work_dir(spark, "queries")
    asked = quantised(queries, id_col, vector_col).withColumn("version", F.xxhash64("terms")).dropDuplicates(["vec_id", "version"])
    asked.write.option("maxRecordsPerFile", 1 << 20).parquet(path)
    target = path if "://" in path else f"file://{path}"

    def blocks() -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(target)
        for info in system.get_file_info(fs.FileSelector(folder)):
            if info.path.endswith(".parquet"):
                with system.open_input_file(info.path) as file:
                    yield from pq.ParquetFile(file).iter_batches(BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for x in batches:
            held.append(x)
            n += len(x)
            if n >= CHUNK:
                yield from score(held)
                held, n = [], 0
        if n:
            yield from score(held)

    def score(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        terms = whole.column("terms").combine_chunks()
        terms = terms.chunk(0) if isinstance(terms, pa.ChunkedArray) else terms
        yield from _score(whole.column("vec_id").to_numpy(), terms, blocks(), k)

    kind = "query_id bigint, version bigint, vec_id bigint, score bigint"
    best = W.partitionBy("query_id", "version").orderBy(F.desc("score"), "vec_id")
    return (
        quantised(df, id_col, vector_col).mapInArrow(run, kind)
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
