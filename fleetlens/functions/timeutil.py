"""Time parsing and windows. Session zone is UTC; local days use the trace's own offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACE_OFFSET = "+08:00"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def relative_seconds(text: str | Column) -> Column:
    """Numeric time cell as seconds, NULL for an ISO cell."""
    return F.trim(_c(text)).try_cast("double")


def instant(text: str | Column) -> Column:
    """ISO time cell as a timestamp, NULL for a numeric cell."""
    raw = F.trim(_c(text))
    return F.when(raw.try_cast("double").isNull(), F.try_to_timestamp(raw))


def _fail_unless_readable(text: str | Column, parsed: Column, kind: str) -> Column:
    raw = _c(text)
    readable = F.trim(raw).try_cast("double").isNotNull() | F.try_to_timestamp(F.trim(raw)).isNotNull()
    broken = _blank(raw) | ~F.coalesce(readable, F.lit(False))
    error = F.raise_error(F.concat(F.lit("unparseable timestamp: "), F.coalesce(raw, F.lit("<null>")))).cast(kind)
    return F.when(broken, error).otherwise(parsed)


def strict_instant(text: str | Column) -> Column:
    """Like :func:`instant`, but a blank or unreadable cell is an error."""
    return _fail_unless_readable(text, instant(text), "timestamp")


def strict_relative_seconds(text: str | Column) -> Column:
    """Like :func:`relative_seconds`, but a blank or unreadable cell is an error."""
    return _fail_unless_readable(text, relative_seconds(text), "double")


def window_bounds(center: str | Column, seconds: float | Column) -> tuple[Column, Column]:
    """``center ± seconds`` for a timestamp column."""
    span = F.make_dt_interval(secs=_secs(seconds))
    return _c(center) - span, _c(center) + span


def relative_bounds(center: str | Column, seconds: float) -> tuple[Column, Column]:
    """``center ± seconds`` for a relative-seconds column."""
    return _c(center) - F.lit(float(seconds)), _c(center) + F.lit(float(seconds))


def _secs(seconds: float | Column) -> Column:
    return seconds if isinstance(seconds, Column) else F.lit(seconds).cast("decimal(18,6)")


def plus_seconds(ts: str | Column, seconds: str | float | Column) -> Column:
    """Shift a timestamp by (possibly fractional) seconds."""
    secs = _c(seconds) if isinstance(seconds, (str, Column)) else F.lit(float(seconds))
    return F.timestamp_micros(F.unix_micros(_c(ts)) + F.round(secs * 1_000_000).cast("bigint"))


def on_grid(ts: str | Column, period_s: int) -> Column:
    """The sampling instant at or before ``ts`` on a grid of ``period_s`` seconds."""
    secs = F.unix_seconds(_c(ts))
    return F.timestamp_seconds(secs - F.pmod(secs, F.lit(period_s)))


def local_day(ts: str | Column, offset: str = TRACE_OFFSET) -> Column:
    return F.date_format(F.from_utc_timestamp(_c(ts), offset), "yyyy-MM-dd")


def iso(ts: str | Column) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss.SSSSSS")
