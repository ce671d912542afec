"""Session settings and the shared work folder."""

from __future__ import annotations

import importlib
import io
import os
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, set[str]] = {}
_LOCAL_ROOTS: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options the library relies on; returns the session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it then gets one folder of its own per
    application.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_ROOTS:
        warehouse = (spark.conf.get("spark.sql.warehouse.dir", None) or "spark-warehouse").removeprefix("file:").rstrip("/")
        _LOCAL_ROOTS[application] = f"{warehouse}/_work-{application}"
    return _LOCAL_ROOTS[application]


def work_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it; a path without scheme is a local one."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file://").removeprefix("file:"))


def stored(path: str, rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a Parquet folder below the shared folder, read by a task in batches of at most ``rows``."""
    system, folder = located(path)
    for info in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as file:
                yield from pq.ParquetFile(file).iter_batches(rows)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor, and are computed once."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(os.path.join(shared_root(spark), "rdd"))
    return df.checkpoint(eager=True)


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def kept(df: DataFrame, folder: str) -> DataFrame:
    """Rows computed once, as a compressed table in a folder below the shared one; see ``removed``."""
    with without_leftovers(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def removed(folder: str) -> None:
    """Delete a table that nothing reads any more."""
    system, root = located(folder)
    system.delete_dir(root)


def spread(df: DataFrame) -> DataFrame:
    """Deal out rows when a small input has fewer splits than the session has cores.

    Text work is CPU-bound, so one input split would keep one core busy. Large inputs have more
    splits than cores and pass through unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession, *packages: str) -> None:
    """Send the packages' source to the Python workers, as ``--py-files`` would, by way of the shared folder."""
    shipped = _SHIPPED.setdefault(spark.sparkContext.applicationId, set())
    for name in packages:
        if name in shipped:
            continue
        folder = Path(importlib.import_module(name).__file__).resolve().parent
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as archive:
            for source in sorted(folder.rglob("*.py")):
                archive.write(source, source.relative_to(folder.parent))
        target = f"{work_dir(spark, 'ship')}/{name}.zip"
        system, path = fs.FileSystem.from_uri(target)
        system.create_dir(os.path.dirname(path))
        with system.open_output_stream(path) as out:
            out.write(packed.getvalue())
        spark.sparkContext.addPyFile(target)
        shipped.add(name)
