"""Explicit clocks. No operator reads the wall clock: callers pass ``as_of``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def instant(as_of) -> Column:
    """Timestamp column for ``as_of``: a Column, a datetime, or ISO text; naive means UTC."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=dt.timezone.utc)
    return F.timestamp_micros(F.lit((as_of - EPOCH) // dt.timedelta(microseconds=1)))


def utc(ntz) -> Column:
    """Zone-less timestamp read as UTC, whatever the session zone is."""
    return F.to_utc_timestamp(F.col(ntz) if isinstance(ntz, str) else ntz, F.current_timezone())


def days_before(as_of, days) -> Column:
    """``as_of`` minus a number of days (int or Column), in elapsed time."""
    days = F.lit(days) if isinstance(days, int) else days
    return instant(as_of) - F.make_dt_interval(days=days)
