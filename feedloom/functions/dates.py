"""Date functions. Every textual dialect is rewritten to ISO text with an offset and cast once.

Strings without an offset are UTC. A regular expression guards each cast, because casts accept
more spellings than the feeds' dialects do.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedloom.clock import instant
from feedloom.functions.binding import let

# The accepted dialects, and each one's parts in ISO order.
ISO = (
    r"^(\d{4}-\d{2}-\d{2})T(\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?)"
    r"(Z|GMT|[+-]\d{2}(?::?\d{2})?)?$"
)
MAIL = (
    r"^(?i:mon|tue|wed|thu|fri|sat|sun), (\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{1,2}:\d{1,2}:\d{1,2})"
    r" ?(Z|GMT|UTC|[+-]\d{2}:?\d{2})$"
)
DAY_FIRST = r"^(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{1,2}:\d{1,2}:\d{1,2})$"
SPACED = r"^(\d{4}-\d{1,2}-\d{1,2}) (\d{1,2}:\d{1,2}:\d{1,2})$"
SLASHED = r"^(\d{4})/(\d{1,2})/(\d{1,2}) (\d{1,2}:\d{1,2}:\d{1,2})$"
NAMED_MONTH = {MAIL: "$3-$2-$1T$4$5", DAY_FIRST: "$3-$2-$1T$4"}
NUMBERED_MONTH = {ISO: "$1T$2$3", SPACED: "$1T$2", SLASHED: "$1-$2-$3T$4"}
ISO_ANY_SEPARATOR = (
    r"(?s)^(\d{4}-\d{2}-\d{2})(?:.(\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?)(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _numbered(text: Column) -> Column:
    """``2024-Jan-15T…`` with the month as a number; an unknown name gives month 0, which no cast accepts."""
    at = F.instr(F.lit(MONTHS), F.lower(F.substring(text, 6, 3)))
    month = F.when(at % 3 == 1, F.floor((at + 2) / 3)).otherwise(0)
    return F.concat(F.substring(text, 1, 5), month.cast("string"), F.substring(text, 9, 40))


def _instant(text: Column) -> Column:
    """Cast ``date T time [offset]``; a missing or named zone is UTC, ``+hhmm`` gets its colon."""
    text = F.regexp_replace(F.translate(text, ",", "."), r"T(\d\d)(?=[-+ZG]|$)", "T$1:00")
    text = F.regexp_replace(text, r"T(\d\d:\d\d)(?=[-+ZG]|$)", "T$1:00")
    text = F.regexp_replace(text, r"(?:Z|GMT|UTC)$|(?<=T[\d:.]{1,30})$", "+00:00")
    text = F.regexp_replace(text, r"([-+]\d\d)(\d\d)?$", "$1:$2")
    text = F.regexp_replace(text, r"([-+]\d\d):$", "$1:00")
    return text.try_cast("timestamp")


def _iso_text(c: Column) -> Column:
    """Text of any dialect rearranged to ISO order; null outside the dialects."""
    text = F.lit(None).cast("string")
    for pattern, order in NAMED_MONTH.items():
        text = F.when(c.rlike(pattern), F.regexp_replace(c, pattern, order)).otherwise(text)
    text = let(text, _numbered)
    for pattern, order in NUMBERED_MONTH.items():
        text = F.when(c.rlike(pattern), F.regexp_replace(c, pattern, order)).otherwise(text)
    return text


def _midnight(c: Column) -> Column:
    date = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.substring(c, 1, 10))
    return F.concat(date, F.lit("T00:00:00+00:00")).try_cast("timestamp")


def parse_published(c) -> Column:
    """Instant of a published string, null when it is empty or in no known dialect.

    ISO text with an impossible time falls back to midnight of its date.
    """
    return let(_col(c), lambda text: F.coalesce(_instant(_iso_text(text)), _midnight(text)))


def iso_utc(ts) -> Column:
    """ISO text with a ``Z`` suffix, independent of the session zone."""
    ts = F.to_utc_timestamp(_col(ts), F.current_timezone())
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def _day(date_text: Column) -> Column:
    return F.date_format(date_text.try_cast("date"), "MMM dd, yyyy")


def format_digest_date(c) -> Column:
    """``Jan 02, 2024`` for ISO text, taking the date as written; anything else unchanged."""
    c = _col(c)
    at = _instant(F.regexp_replace(c, ISO_ANY_SEPARATOR, "$1T$2$3"))
    date_only = F.length(c) == 10
    valid = c.rlike(ISO_ANY_SEPARATOR) & (date_only | at.isNotNull())
    return F.coalesce(F.when(valid, _day(F.substring(c, 1, 10))), c)


def format_date(c) -> Column:
    """As ``format_digest_date`` for ISO, blank-separated and mail dates; null becomes empty."""
    c = F.coalesce(_col(c), F.lit(""))
    known = c.rlike(ISO) | c.rlike(SPACED) | c.rlike(MAIL)

    def written(text: Column) -> Column:
        return F.when(_instant(text).isNotNull(), _day(F.regexp_extract(text, "^[^T]+", 0)))

    return F.coalesce(F.when(known, let(_iso_text(c), written)), c)


# Days per unit of a relative age, in the order the units are tested.
DAYS_PER_UNIT = {"h": None, "d": 1, "w": 7, "m": 30, "y": 365}


def relative_age(c, as_of, mode: str = "strict") -> Column:
    """Instant of an age such as ``3h``, ``2d``, ``1w``, ``4mo`` or ``1y`` before ``as_of``.

    ``strict`` reads a number and the unit next to it. ``reference`` joins all digits and takes the
    first of h, d, w, m, y found anywhere. Text without a usable age gives ``as_of``.
    """
    c = F.lower(F.coalesce(_col(c), F.lit("")))
    now = instant(as_of)
    if mode == "strict":
        number = F.regexp_extract(c, r"(\d+)\s*(?:mo|[hdwmy])", 1)
        has = lambda unit: F.startswith(F.regexp_extract(c, r"\d+\s*(mo|[hdwmy])", 1), F.lit(unit))
    else:
        number = F.regexp_replace(c, r"\D", "")
        has = lambda unit: F.contains(c, F.lit(unit))
    n = number.try_cast("int")
    age = F.lit(None).cast("interval day to second")
    for unit, days in reversed(DAYS_PER_UNIT.items()):
        span = F.make_dt_interval(hours=n) if days is None else F.make_dt_interval(days=n * days)
        age = F.when(has(unit), span).otherwise(age)
    return F.when(F.contains(c, F.lit("now")), now).otherwise(F.coalesce(now - age, now))


def long_date(ts) -> Column:
    """``Monday, January 15, 2024`` in UTC."""
    return F.date_format(F.to_utc_timestamp(_col(ts), F.current_timezone()), "EEEE, MMMM dd, yyyy")
