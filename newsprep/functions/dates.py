"""Dates and time stamps (DT-1..3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column

# day/month/year, and the stamp of request parameters.
DAY_FORMAT = "d/M/yyyy"
# Fixed value: the shape of an RFC 3339 stamp.
RFC_3339 = "^\\d{4}-\\d{2}-\\d{2}[Tt ]\\d{2}:\\d{2}:\\d{2}(?:\\.\\d+)?(?:[Zz]|[+-]\\d{2}:\\d{2})$"
ISO_Z_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def parse_day(c: Column | str, strict: bool = False) -> Column:
    """DT-1: day/month/year to a date; bad input is null, or an error when ``strict``."""
    text = as_column(c)
    day = F.try_to_date(text, DAY_FORMAT)
    if not strict:
        return day
    message = F.concat(F.coalesce(text, F.lit("null")), F.lit(" is not a day/month/year date"))
    return F.when(day.isNull(), F.raise_error(message).cast("date")).otherwise(day)


def iso_z(c: Column | str) -> Column:
    """DT-2: ``YYYY-MM-DDTHH:MM:SSZ``; the session zone must be UTC."""
    return F.date_format(as_column(c), ISO_Z_FORMAT)


def parse_rfc3339(c: Column | str) -> Column:
    """DT-3: RFC 3339 to a timestamp; null when it is anything else, a date or a time alone included."""
    text = as_column(c)
    return F.when(F.rlike(text, F.lit(RFC_3339)), F.try_to_timestamp(text))
