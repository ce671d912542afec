"""Positions and running totals over a whole table without a single-task sort."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsprep.session import materialize, work_dir


def running_total(df: DataFrame, order_by: Sequence[str], value: Column, name: str = "before") -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows in the order ``order_by``, which is unique.

    Two passes: the rows are range-partitioned and checkpointed, so that both passes see the same
    partitions even if executors are lost; the totals of the partitions, one row each, give
    every partition its offset; within a partition the sum is local. Pass keys and counts, not
    long text: the rows are written once.
    """
    ranged = materialize(
        df.withColumn("_value", value.cast("bigint"))
        .repartitionByRange(*order_by)
        .withColumn("_range", F.spark_partition_id())
    )
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range").agg(F.sum("_value").alias("_total"))
        .select("_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    )
    local = F.sum("_value").over(
        W.partitionBy("_range").orderBy(*order_by).rowsBetween(W.unboundedPreceding, -1)
    )
    # One offset per range partition: the size is bounded by the number of shuffle partitions.
    return (
        ranged.withColumn("_local", F.coalesce(local, F.lit(0)))
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_range", "_value", "_local", "_offset")
    )


def carried_total(df: DataFrame, order_by: Sequence[str], value: Column, name: str = "before") -> DataFrame:
    """As ``running_total``, in one exchange: each sorted range is summed in one pass that carries its total.

    The rows are written once, with the number of their range; the totals of the ranges, no more
    than there are shuffle partitions, give every range its offset. Pass keys and counts, not long text.
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType()), T.StructField("_local", T.LongType()), T.StructField("_after", T.LongType()), T.StructField("_place", T.LongType())])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = place = 0
        for x in batches:
            values = x.column("_value").fill_null(0).to_numpy(zero_copy_only=False)
            after = total + np.cumsum(values, dtype=np.int64)
            if len(after):
                total = int(after[-1])
            rest = x.drop_columns(["_value"])
            sums = [pa.array(after - values), pa.array(after), pa.array(np.arange(place, place + len(after)))]
            place += len(after)
            yield pa.RecordBatch.from_arrays([*rest.columns, *sums], names=[*rest.schema.names, "_local", "_after", "_place"])

    ranged = df.withColumn("_value", value.cast("bigint")).repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = ranged.select(*[F.col(f"`{c}`") for c in df.columns], F.spark_partition_id().alias("_range"), "_value")
    path = work_dir(spark, "carried")
    placed.mapInArrow(carry, schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    totals = {r["_range"]: r["n"] for r in rows.groupBy("_range").agg(F.max_by("_after", "_place").alias("n")).collect()}  # one per range
    offsets, before = [], 0
    for number in sorted(totals):
        offsets.append((number, before))
        before += totals[number]
    table = spark.createDataFrame(pa.table({"_range": pa.array([o[0] for o in offsets], pa.int32()), "_offset": pa.array([o[1] for o in offsets], pa.int64())}))
    summed = rows.join(F.broadcast(table), "_range").withColumn(name, F.col("_offset") + F.col("_local"))
    return summed.drop("_range", "_local", "_after", "_place", "_offset")
