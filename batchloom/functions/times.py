"""Zone-less timestamps, independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def hour_of(ts: Column) -> Column:
    """The hour a zone-less timestamp lies in."""
    return F.make_timestamp_ntz(*_date(ts), F.hour(ts), F.lit(0), F.lit(0))


def utc_instant(ts: Column) -> Column:
    """A zone-less timestamp read as UTC."""
    seconds = F.date_part(F.lit("SECOND"), ts)
    return F.make_timestamp_ltz(*_date(ts), F.hour(ts), F.minute(ts), seconds, F.lit("UTC"))


def utc_clock(instant: Column) -> Column:
    """The zone-less timestamp of an instant in UTC."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(_EPOCH))


def _date(ts: Column) -> tuple[Column, Column, Column]:
    return F.year(ts), F.month(ts), F.dayofmonth(ts)
