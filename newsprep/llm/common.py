"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprep.session import located, work_dir

#: A word where only blanks and line breaks separate.
BLANK_WORD = r"[^\x20\x09-\x0D]+"
#: Bytes as they are, but A-Z in lower case.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: As LOWER, and every ASCII byte that is no letter or digit becomes a blank. Bytes from 0x80 on are parts of words.
PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
MASK = (1 << 64) - 1


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe when executors are lost."""
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    # Spark removes shuffle files once the driver has collected the plan that made them: do it now, not when its heap is full.
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that no later table or result reads."""
    for df in tables:
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            system, path = located(unquote(folder))
            system.delete_dir(path)


def stored(path: str, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The rows of a folder of Parquet files below the shared folder, read by a task; none where there is no folder."""
    system, folder = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as file:
                yield from pq.ParquetFile(file).iter_batches(rows)


def utf8_size(text: Column) -> Column:
    """UTF-8 bytes; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 texts of an Arrow string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(x: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of rows whose texts have about ``limit`` bytes; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(x.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(x):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield x.slice(at, end - at)
        at = end


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
