"""Windows and calendar periods, in UTC seconds. The session's time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = {"hour": "yyyy-MM-dd'T'HH", "day": "yyyy-MM-dd", "month": "yyyy-MM"}


def window_start(ts: Column, res: int) -> Column:
    """Start of the window of res seconds that ts lies in; floors, so it holds before 1970 as well."""
    return ts - F.pmod(ts, F.lit(res))


def period(ts: Column, per: str) -> Column:
    """2026-09, 2026-09-28 or 2026-09-28T09."""
    return F.date_format(F.timestamp_seconds(ts), FORMATS[per])


def period_end(ts: Column, per: str) -> Column:
    """First second after the period of ts."""
    if per == "month":
        return F.unix_timestamp(F.add_months(F.trunc(F.timestamp_seconds(ts), "month"), 1).cast("timestamp"))
    length = 3600 if per == "hour" else 86400
    return window_start(ts, length) + length


def within_period(column: Column, asked: Column | str) -> Column:
    """Is the period of column the one asked for, or part of it (a day of a month, an hour of a day)?"""
    asked = F.lit(asked) if isinstance(asked, str) else asked
    rest = F.substr(column, F.length(asked) + 1, F.lit(1))
    return (column == asked) | (F.startswith(column, asked) & rest.isin("-", "T"))
