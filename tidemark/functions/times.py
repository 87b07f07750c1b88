"""Calendar days and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_day(ts: Column, zone: str = "Asia/Jerusalem") -> Column:
    """The calendar day there of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def within(ts: Column, start: str, end: str) -> Column:
    return (ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(end).cast("timestamp"))
