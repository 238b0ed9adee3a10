"""Instants. Every time-dependent operator takes an explicit `as_of`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headway.model import BOARD_FORMAT, TIMESTAMP_FORMATS


def instant(as_of=None) -> Column:
    """`as_of` as a timestamp: datetime, text, epoch seconds or column; now if None.

    Text and naive datetimes are in the session time zone.
    """
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of.cast("timestamp")
    if isinstance(as_of, (int, float)):
        return F.timestamp_seconds(F.lit(as_of))
    text = as_of.isoformat(sep=" ") if hasattr(as_of, "isoformat") else as_of
    return F.lit(text).cast("timestamp")


def epoch(as_of=None) -> Column:
    """`as_of` in epoch seconds."""
    return F.unix_seconds(instant(as_of))


def seconds_of(col) -> Column:
    """Epoch seconds of a timestamp column, with or without time zone."""
    return F.unix_seconds(F.col(col).cast("timestamp") if isinstance(col, str) else col.cast("timestamp"))


def floor_to(seconds: Column, step: int) -> Column:
    """Largest multiple of `step` that is not above `seconds`."""
    return seconds - F.pmod(seconds, F.lit(step))


def clock_text(seconds: Column) -> Column:
    """Epoch seconds as local `HH:mm:ss`."""
    return F.from_unixtime(seconds, "HH:mm:ss")


def message_timestamp(text: Column, formats=TIMESTAMP_FORMATS) -> Column:
    """First of `formats` that reads `text`; NULL if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def message_text(ts: Column) -> Column:
    """A timestamp in the main message format."""
    return F.date_format(ts, TIMESTAMP_FORMATS[0])


def board_timestamp(text: Column) -> Column:
    """Departure-board time, `dd/MM/yyyy HH:mm`."""
    return F.try_to_timestamp(text, F.lit(BOARD_FORMAT))


def local_text(seconds: Column) -> Column:
    """Epoch seconds as local `yyyy-MM-dd HH:mm:ss`."""
    return F.from_unixtime(seconds, TIMESTAMP_FORMATS[1])
