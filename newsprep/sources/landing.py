"""The landing folder of raw message frames, one JSON array per line (SRC-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def landing_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """SRC-4: a stream of frames. ``max_files`` bounds the files of one micro-batch."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def landing_batch(spark: SparkSession, path: str) -> DataFrame:
    """The same frames as a table."""
    return spark.read.text(path)
