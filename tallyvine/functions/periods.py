"""Calendar periods in UTC milliseconds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(ms: Column) -> Column:
    """First instant of the month of a millisecond instant, as milliseconds."""
    return F.unix_millis(F.date_trunc("month", F.timestamp_millis(ms)))


def next_month_start(ms: Column) -> Column:
    """First instant of the following month, as milliseconds."""
    first = F.to_date(F.date_trunc("month", F.timestamp_millis(ms)))
    return F.unix_millis(F.add_months(first, 1).cast("timestamp"))


def month_bounds(year: int, month: int) -> tuple[int, int]:
    """Half-open ``[start, next start)`` of a calendar month in UTC ms."""
    if not 1 <= month <= 12:
        raise ValueError(f"month must be 1..12, got {month}")
    first = dt.datetime(year, month, 1, tzinfo=dt.timezone.utc)
    following = (first + dt.timedelta(days=32)).replace(day=1)
    return int(first.timestamp() * 1000), int(following.timestamp() * 1000)


def period_bounds(period: str, now_ms: int) -> tuple[int, int]:
    """``last_month`` or, for any other value, the month of ``now_ms``."""
    now = dt.datetime.fromtimestamp(now_ms / 1000, tz=dt.timezone.utc)
    if period == "last_month":
        before = now.replace(day=1) - dt.timedelta(days=1)
        return month_bounds(before.year, before.month)
    return month_bounds(now.year, now.month)
