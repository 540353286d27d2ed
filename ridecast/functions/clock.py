"""Clock strings "H:MM": to minutes, to (hour, minute)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clock_text(ts) -> Column:
    """Timestamp -> "H:mm" text, the shape of the ticket files' clock column."""
    return F.date_format(_col(ts), "H:mm")


def clock_hour(c) -> Column:
    return F.split(_col(c), ":", 2).getItem(0).cast("int")


def clock_minute(c) -> Column:
    return F.split(_col(c), ":", 2).getItem(1).cast("int")


def time_to_minutes(c) -> Column:
    """"H:MM" -> H * 60 + MM."""
    return (clock_hour(c) * 60 + clock_minute(c)).cast("int")
