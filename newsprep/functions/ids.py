"""Content hashes (STR-14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column


def content_id(c: Column | str) -> Column:
    """md5 of the text, lower-case hex."""
    return F.md5(as_column(c))


def hash_bucket(c: Column | str, n: int) -> Column:
    """A stable bucket in ``[0, n)`` from the first eight hex digits of the md5."""
    return F.conv(F.substring(F.md5(as_column(c)), 1, 8), 16, 10).cast("bigint") % F.lit(n)
