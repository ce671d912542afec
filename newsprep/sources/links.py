"""Which articles a chunk comes from: a bridge table beside the collection (PRJ-8, D15).

The collection keeps one payload per chunk. The bridge keeps a narrow row for every chunk and
article, however many share a chunk; no list is gathered per chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsprep.operators.latest import latest

from .collection import PLACE, commit_batch, committed

_LINK = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("article_id", T.LongType()), T.StructField("doc_id", T.StringType()),
    T.StructField("updated_at", T.TimestampType()),
])


def link_sources(chunks: DataFrame, path: str, run_id: str, batch_id: int) -> None:
    """Write the links of a batch of chunks below the collection ``path``; a batch written again is replaced."""
    pairs = latest(
        chunks.select(*_LINK.names).withColumn("_pair", F.struct("chunk_id", "article_id")), "_pair", ("updated_at", "doc_id")
    ).drop("_pair")
    commit_batch(pairs.withColumns({"state": F.lit("ok"), "bucket": F.lit(0)}), f"{path}/sources", run_id, batch_id)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """``chunk_id, article_id, doc_id, updated_at``: for every chunk and article the last write."""
    folders = [f"{path}/sources/{e['folder']}/state=ok" for e in committed(spark, f"{path}/sources").where("rows > 0").collect()]
    if not folders:
        return spark.createDataFrame([], _LINK)
    rows = spark.read.schema(T.StructType([*_LINK.fields, *PLACE])).option("basePath", f"{path}/sources/log").parquet(*folders)
    paired = rows.withColumn("_pair", F.struct("chunk_id", "article_id"))
    return latest(paired, "_pair", ("updated_at", "batch_id", "attempt")).select(*_LINK.names)
