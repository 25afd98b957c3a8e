"""Look-back ranges. "Now" is always given, so that results can be repeated."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMAT = "%Y-%m-%d %H:%M:%S"
DEFAULT_HOURS = 24
DEFAULT_DAYS = 7

TimeRange = tuple[str, str]


def look_back(as_of: str, hours: float = DEFAULT_HOURS) -> TimeRange:
    """The last ``hours`` hours before ``as_of``."""
    return (datetime.strptime(as_of, FORMAT) - timedelta(hours=hours)).strftime(FORMAT), as_of


def resolve_range(
    start: str | None, end: str | None, as_of: str, hours: float = DEFAULT_HOURS
) -> TimeRange:
    """Both given: that range; only a start: until ``as_of``; none: the last hours.

    An end without a start has no defined meaning and is an error.
    """
    for text in (start, end):
        if text is not None:
            datetime.strptime(text, FORMAT)
    if start is None and end is not None:
        raise ValueError("end_time needs a start_time")
    if start is None:
        return look_back(as_of, hours)
    return start, end if end is not None else as_of


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def in_range(column: str, span: TimeRange) -> Column:
    return F.col(column).between(moment(span[0]), moment(span[1]))


def range_label(start: Column, end: Column) -> Column:
    shape = "yyyy-MM-dd HH:mm:ss"
    return F.concat_ws(" to ", F.date_format(start, shape), F.date_format(end, shape))


def from_millis(column: str) -> Column:
    """Epoch milliseconds to a time without zone (UTC); 0 and null give null."""
    return F.timestamp_millis(F.nullif(F.col(column), F.lit(0))).cast("timestamp_ntz")


def to_millis(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))
