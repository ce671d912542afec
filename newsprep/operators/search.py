"""Bulk top-k search by cosine (JOIN-1, TOP-1, FLT-2).

Every question is compared with every point, but the pairs never become rows. The questions are
written once, in blocks, to the shared folder. The points are read where they stand, without a
shuffle: a task holds a chunk of them, as many as fit into ``HELD`` bytes, takes block after block
of questions and emits at most ``k`` rows per question. A window then keeps the best ``k`` of
those. It is the same plan for one question and for any number; the driver sees neither side.

Pairs are screened by matrix products of single precision, with a margin above their rounding
error; only those that may be among the best ``k`` are scored, in double precision.

With ``prune`` a chunk is cut into blocks of points with an upper bound on their scores, and a
block is left out for every question whose ``k``-th score so far is above the bound. Nothing is
sampled or capped: all ways give the same exact result.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsprep.session import stored, work_dir

from .pruning import METHODS, prune_pairs

#: Bytes of vectors that a task holds as one chunk of points.
HELD = 16 << 20
#: Questions and points of one matrix product at most; points of the first, which sets the bars of the others; pairs scored at once.
_COLUMNS, _ROWS, _FIRST, _PAIRS = 512, 2048, 1024, 1 << 15


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal-length vectors of a column as one matrix, in the precision of the column."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks)
    if len(vectors) == 0:
        return np.zeros((0, 0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return np.asarray(values)


def _sortable(ids: np.ndarray) -> np.ndarray:
    return ids.astype("U") if ids.dtype == object else ids


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))


def _rounded(dots: np.ndarray, length: np.ndarray) -> np.ndarray:
    raw = np.divide(dots, length, out=np.zeros_like(dots), where=length != 0)
    return np.sign(raw) * np.floor(np.abs(raw) * 1e6 + 0.5) / 1e6


def scores(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosine of every point with every query, rounded half up at six places; 0 for a zero vector."""
    points, queries = points.astype(np.float64, copy=False), queries.astype(np.float64, copy=False)
    return _rounded(points @ queries.T, np.outer(lengths(points), lengths(queries)))


class Side:
    """Points or questions, with unit vectors of single precision that screen the pairs."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.lengths, self.numbers = vectors, lengths(vectors), np.arange(len(vectors))
        self.unit = np.zeros(vectors.shape, np.float32)
        for at in range(0, len(vectors), _ROWS):
            length = self.lengths[at:at + _ROWS, None]
            np.divide(vectors[at:at + _ROWS], length, out=self.unit[at:at + _ROWS], where=length != 0, casting="same_kind")


class Best:
    """The best ``k`` points of each question so far: by score, then by number, which is by id."""

    def __init__(self, questions: int, k: int):
        self.k = k
        self.score, self.point = np.full((questions, k), -np.inf), np.full((questions, k), -1)

    def take(self, query: np.ndarray, point: np.ndarray, score: np.ndarray) -> None:
        some, place = np.unique(query, return_inverse=True)
        place = np.concatenate((np.repeat(np.arange(len(some)), self.k), place))
        score = np.concatenate((self.score[some].ravel(), score))
        point = np.concatenate((self.point[some].ravel(), point))
        order = np.lexsort((point, -score, place))
        place = place[order]
        keep = order[np.arange(len(place)) - np.searchsorted(place, place, side="left") < self.k]
        self.score[some], self.point[some] = score[keep].reshape(-1, self.k), point[keep].reshape(-1, self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Questions, scores and points."""
        query, place = np.nonzero(self.point >= 0)
        return query, self.score[query, place], self.point[query, place]


def _candidates(block: np.ndarray, bar: np.ndarray, k: int) -> np.ndarray:
    """Which scores of a block may be among the best ``k``; rows are in id order.

    Many equal scores are no reason to keep more than ``k``: of those at the bar the first rows,
    that is the smallest ids, are enough.
    """
    rows, columns = block.shape
    chosen = block >= bar
    if rows <= k or np.count_nonzero(chosen) <= 2 * k * columns:
        return chosen
    bar = np.maximum(bar, np.partition(block, rows - k, axis=0)[rows - k])
    above, level = block > bar, block == bar
    room = k - np.count_nonzero(above, axis=0)
    return above | (level & (np.cumsum(level, axis=0, dtype=np.int32) <= room))


def _meet(points: Side, rows, asked: Side, columns: np.ndarray, best: Best) -> None:
    """Give ``best`` what one product finds; ``rows`` are in id order."""
    number, k = points.numbers[rows], best.k
    block = asked.unit[columns] @ points.unit[rows].T
    floor = best.score[columns, -1]
    # Above the error of a product of single precision and of rounding at six places.
    slack = (points.unit.shape[1] + 16) * 2.0**-23 + 1e-6
    chosen = block >= (floor - slack)[:, None].astype(np.float32)
    if len(number) > k and np.count_nonzero(chosen) > 8 * k * len(columns):
        level = np.partition(block, len(number) - k, axis=1)[:, len(number) - k]
        chosen = block >= np.maximum(floor - slack, level - 2 * slack)[:, None].astype(np.float32)
    if np.count_nonzero(chosen) > 8 * k * len(columns):
        # Questions with many points about their bar, equal ones mostly: all scores, and of those at the bar the first rows.
        many = np.flatnonzero(np.count_nonzero(chosen, axis=1) > max(8 * k, len(number) // 16))
        if len(many):
            score = scores(points.vectors[rows], asked.vectors[columns[many]])
            row, column = np.nonzero(_candidates(score, floor[many], k))
            best.take(columns[many][column], number[row], score[row, column])
            chosen[many] = False
    column, row = np.divmod(np.flatnonzero(chosen), max(1, len(number)))
    column, row = columns[column], number[row]
    for at in range(0, len(row), _PAIRS):
        q, p = column[at:at + _PAIRS], row[at:at + _PAIRS]
        dots = np.einsum("ij,ij->i", points.vectors[p], asked.vectors[q], dtype=np.float64)
        score = _rounded(dots, points.lengths[p] * asked.lengths[q])
        enough = score >= best.score[q, -1]
        best.take(q[enough], p[enough], score[enough])


def meet(points: Side, rows: np.ndarray, asked: Side, columns: np.ndarray, best: Best, query_block: int = _COLUMNS, point_block: int = _ROWS) -> None:
    """All pairs of the numbered points and questions, in products of at most ``point_block`` by ``query_block``."""
    high, wide = min(point_block, _ROWS), min(query_block, _COLUMNS)
    first = min(high, _FIRST)
    for left in range(0, len(columns), wide):
        some = columns[left:left + wide]
        _meet(points, rows[:first], asked, some, best)
        for at in range(first, len(rows), high):
            _meet(points, rows[at:at + high], asked, some, best)


def _out_schema(queries: DataFrame, points: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("chunk_id", points.schema["chunk_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def _rows(query_ids: np.ndarray, found, types: list[pa.DataType]) -> list[pa.Array]:
    query, score, point = found
    return [
        pa.array(query_ids[query].tolist(), types[0]), pa.array(point.tolist(), types[1]), pa.array(score, pa.float64()),
    ]


def _arrow_types(schema: T.StructType) -> list[pa.DataType]:
    known = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}
    for name in ("query_id", "chunk_id"):
        if schema[name].dataType not in known:
            raise TypeError(f"{name} must be a string or an integer, not {schema[name].dataType.simpleString()}")
    return [known[schema[name].dataType] for name in ("query_id", "chunk_id")]


_NAMES = ["query_id", "chunk_id", "score"]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors in chunks of about ``HELD`` bytes, in id order. Vectors without a finite length score with nothing."""

    def whole(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        ids = ids_of(pa.chunked_array([x.column(0) for x in held]))
        parts = [matrix(x.column(1)) for x in held if len(x)]
        held.clear()
        order = np.argsort(_sortable(ids), kind="stable")
        order = order[np.concatenate([np.isfinite(lengths(p)) for p in parts])[order]]
        # Rows go straight from the batches to their places, so that the vectors are held twice and no more.
        place = np.full(len(ids), -1)
        place[order] = np.arange(len(order))
        vectors = np.empty((len(order), parts[0].shape[1]), parts[0].dtype)
        start = 0
        for part in parts:
            for at in range(0, len(part), _ROWS):
                some = part[at:at + _ROWS]
                to = place[start:start + len(some)]
                vectors[to[to >= 0]] = some[to >= 0]
                start += len(some)
        return ids[order], vectors

    held: list[pa.RecordBatch] = []
    size = 0
    for x in batches:
        held.append(x)
        size += x.nbytes
        if size >= HELD:
            yield whole(held)
            size = 0
    if sum(map(len, held)):
        yield whole(held)


def _found(
    queries: DataFrame, points: DataFrame, k: int, query_block: int, point_block: int, prune: str | None
) -> DataFrame:
    """``query_id, chunk_id, score`` of the best of every chunk; and with pruning a row without ids for every pair of a
    chunk and a block of questions, whose ``pairs`` and ``skipped`` count blocks of points times questions."""
    schema = _out_schema(queries, points)
    types = _arrow_types(schema)
    path = work_dir(points.sparkSession, "questions")
    queries.write.option("maxRecordsPerFile", 1 << 20).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _chunks(batches):
            if not len(ids):
                continue
            points = Side(vectors)
            method = METHODS[prune](vectors) if prune else None
            for block in stored(path, query_block):
                query_ids = ids_of(block.column(0))
                if not len(query_ids):
                    continue
                asked, best, pairs, skipped = Side(matrix(block.column(1))), Best(len(query_ids), k), None, None
                if method is None:
                    meet(points, points.numbers, asked, asked.numbers, best, query_block, point_block)
                else:
                    pairs, skipped = prune_pairs(method, asked.vectors, best, partial(meet, points, asked=asked, best=best))
                query, score, at = best.found()
                found = query, score, ids[at]
                arrays = _rows(query_ids, found, types)
                none = pa.nulls(len(arrays[2]), pa.int64())
                yield pa.RecordBatch.from_arrays([*arrays, none, none], names=[*_NAMES, "pairs", "skipped"])
                if pairs is not None:
                    report = [pa.nulls(1, types[0]), pa.nulls(1, types[1]), pa.nulls(1, pa.float64()), pa.array([pairs]), pa.array([skipped])]
                    yield pa.RecordBatch.from_arrays(report, names=[*_NAMES, "pairs", "skipped"])

    counted = T.StructType([*schema.fields, T.StructField("pairs", T.LongType()), T.StructField("skipped", T.LongType())])
    return points.mapInArrow(run, counted)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return found.select(*_NAMES).withColumn("rank", rank).where(F.col("rank") <= k)


def search(
    queries: DataFrame,
    points: DataFrame,
    k: int = 1,
    since: str | None = None,
    as_of: datetime | None = None,
    query_block: int = 4096,
    point_block: int = 65536,
    created_at: str = "payload.created_at",
    prune: str | None = None,
) -> DataFrame:
    """JOIN-1, TOP-1: the ``k`` nearest points of every question.

    ``queries`` has ``query_id`` and ``vector``; ``points`` has ``chunk_id`` and ``vector``; both
    ids are unique and all vectors have one length. Returns ``query_id, chunk_id, score, rank``;
    ties in the rounded score go to the smaller id. ``since`` (FLT-2) is an interval such as
    ``24 hours``: only points created within it up to ``as_of`` are scored. A task reads ``query_block``
    questions at a time, and compares them with at most ``point_block`` points at once. ``prune`` is ``clusters`` for dense
    vectors that lie in groups, ``impacts`` for word counts, or None.

    The questions are written, and so computed, once, when this is called.
    """
    if since is not None:
        at = F.lit(as_of).cast("timestamp") if as_of is not None else F.current_timestamp()
        created = F.col(created_at)
        points = points.where((created >= at - F.expr(f"interval {since}")) & (created <= at))
    found = _found(queries.select("query_id", "vector"), points.select("chunk_id", "vector"), k, query_block, point_block, prune)
    return _ranked(found.where(F.col("query_id").isNotNull()) if prune else found, k)


def search_report(
    queries: DataFrame, points: DataFrame, k: int, prune: str, query_block: int = 4096, point_block: int = 65536
) -> tuple[DataFrame, DataFrame]:
    """The matches of a pruned search, and one row that counts the pairs of a block of points and a question and those skipped.

    The narrow results are written once, and both are read from them.
    """
    found = _found(queries.select("query_id", "vector"), points.select("chunk_id", "vector"), k, query_block, point_block, prune)
    path = work_dir(points.sparkSession, "matches")
    found.write.parquet(path)
    rows = points.sparkSession.read.schema(found.schema).parquet(path)
    report = rows.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))
    return _ranked(rows.where(F.col("query_id").isNotNull()), k), report


def with_payload(matches: DataFrame, points: DataFrame, field: str | None = None) -> DataFrame:
    """Payloads of the matched points, fetched after the search so that scoring reads ids and vectors only."""
    wanted = "payload" if field is None else F.col(f"payload.{field}").alias(field)
    return matches.join(points.select("chunk_id", wanted), "chunk_id")
