"""Instants written as text, timeframes, and the calendar grid of a cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
WEEK = 7 * DAY
#: Monday 1969-12-29 is this long before the epoch.
WEEK_SHIFT = 3 * DAY
#: Length of a timeframe in ms (a month counts 30 days where a length is meant).
LENGTH_MS = {
    "1m": MINUTE, "3m": 3 * MINUTE, "5m": 5 * MINUTE, "15m": 15 * MINUTE, "30m": 30 * MINUTE,
    "1h": HOUR, "2h": 2 * HOUR, "4h": 4 * HOUR, "6h": 6 * HOUR, "8h": 8 * HOUR, "12h": 12 * HOUR,
    "1d": DAY, "1w": WEEK, "1mo": 30 * DAY,
}


def instant_ms(text: Column) -> Column:
    """Epoch ms of an instant written as ISO-8601 (any offset, with or without ms) or as epoch ms.

    Text without an offset is UTC, whatever the session's zone; unreadable text gives null.
    """
    text = F.trim(text)
    zoned = F.when(text.rlike(r"[+-]\d{2}:?\d{2}$"), text).otherwise(F.concat(text, F.lit("Z")))
    return (
        F.when(text.endswith("Z"), F.unix_millis(text.try_cast("timestamp")))
        .when(text.rlike(r"^-?\d+$"), text.try_cast("long"))
        .otherwise(F.unix_millis(zoned.try_cast("timestamp")))
    )


def number(text: Column) -> Column:
    """Double of decimal text, exponents included; unreadable or non-finite text gives null."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def length_ms(timeframe: Column) -> Column:
    """Length of the timeframe in ms; null for an unknown one."""
    return F.create_map(*[F.lit(x) for kv in LENGTH_MS.items() for x in kv])[timeframe].cast("long")


def _length_case(timeframe: Column) -> Column:
    out = F.lit(None).cast("long")
    for name, ms in LENGTH_MS.items():
        out = F.when(timeframe == name, F.lit(ms).cast("long")) if name == "1m" else out.when(timeframe == name, F.lit(ms).cast("long"))
    return out


def slot_index(timeframe: Column, ms: Column) -> Column:
    """Number of the grid period that contains ``ms``: epoch multiples, Monday weeks, calendar months."""
    at = F.timestamp_millis(ms)
    return (
        F.when(timeframe == "1mo", (F.year(at) * 12 + F.month(at) - 1).cast("long"))
        .when(timeframe == "1w", F.floor((ms + WEEK_SHIFT) / F.lit(float(WEEK))).cast("long"))
        .otherwise(F.floor(ms / _length_case(timeframe).cast("double")).cast("long"))
    )


def slot_start_ms(timeframe: Column, index: Column) -> Column:
    """Start of the period with this number, in epoch ms; the inverse of :func:`slot_index`."""
    month = F.make_date(F.floor(index / F.lit(12.0)).cast("int"), (index % 12 + 1).cast("int"), F.lit(1))
    return (
        F.when(timeframe == "1mo", F.unix_date(month).cast("long") * DAY)
        .when(timeframe == "1w", index * WEEK - WEEK_SHIFT)
        .otherwise(index * _length_case(timeframe))
    )


def row_slot(timeframe: Column, open_ms: Column, close_ms: Column) -> Column:
    """The slot a row belongs to: that of its opening or, if unknown, the one ending at its close."""
    return slot_index(timeframe, F.coalesce(open_ms, close_ms - 1))
