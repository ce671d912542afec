"""Contiguous shards of equal bytes, cut from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import utf8_size, written


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the bytes and rows before each row within it."""
    part, size, rows = TaskContext.get().partitionId(), 0, 0
    for x in batches:
        sizes = x.column("size").to_numpy()
        before = size + np.cumsum(sizes) - sizes
        columns = [*x.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(before), pa.array(rows + np.arange(len(sizes)))]
        yield pa.RecordBatch.from_arrays(columns, names=[*x.schema.names, "_part", "_bytes", "_rows"])
        size, rows = size + int(sizes.sum()), rows + len(sizes)


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``docs``.

    Rows are laid end to end in the order of their ids (null first, then checksum and size); a row
    belongs to the shard in whose equal part of all bytes its middle lies, so that every cut is at
    most half a row off. A row larger than a part leaves a neighbour shard empty. Rows that agree
    in all of these are interchangeable and are spread by a hash of their position, so that many of
    them do not meet in one range. Null text has one byte. An empty table gives an empty result;
    other columns are ignored. Only ids and numbers are shuffled, once, and each range contributes
    one total.
    """
    sized = written(
        docs.select(
            F.col(id_col).alias("doc_id"), (utf8_size(F.col(text_col)) + 1).alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(F.monotonically_increasing_id()).alias("_spread"),
        ), "shard-sizes",
    )
    order = ["doc_id", "text_crc32", "size", "_spread"]
    ranged = sized.repartitionByRange(*order).sortWithinPartitions(*order).drop("_spread")
    schema = "doc_id bigint, size bigint, text_crc32 bigint, _part int, _bytes bigint, _rows bigint"
    schema = schema.replace("bigint", sized.schema["doc_id"].dataType.simpleString(), 1)
    placed = written(ranged.mapInArrow(_running, schema), "shard-ranges")
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(F.sum("size").alias("_size"), F.count("*").alias("_n"))
    # One row per range partition: bounded by the number of shuffle partitions.
    offsets = totals.select(
        "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_bytes_0"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows_0"),
    )
    whole = totals.agg(F.sum("_size").alias("_all"))
    middle = (F.col("_bytes") + F.col("_bytes_0")) * 2 + F.col("size")
    number = F.least(F.call_function("div", middle * shards, F.col("_all") * 2), F.lit(shards - 1)).cast("int")
    dealt = (
        placed.join(F.broadcast(offsets), "_part").join(F.broadcast(whole))
        .withColumn("shard", number).withColumn("_row", F.col("_rows") + F.col("_rows_0"))
    )
    first = dealt.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row per shard
    return dealt.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
