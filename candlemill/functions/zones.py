"""Instants and wall clocks. Instants are kept as UTC without a zone; the exchange's zone decides sessions.

A wall-clock time that occurs twice means the earlier instant; one that a change of clocks skips moves forward by the
length of the gap, as Spark has it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_utc(local: Column, zone: Column) -> Column:
    """The instant of a wall-clock time."""
    return F.to_utc_timestamp(local.cast("timestamp_ntz").cast("timestamp"), zone).cast("timestamp_ntz")


def to_local(instant: Column, zone: Column) -> Column:
    """The wall clock at an instant (UTC)."""
    return F.convert_timezone(F.lit("UTC"), zone, instant)


def offset_minutes(instant: Column, zone: Column) -> Column:
    return F.timestamp_diff("MINUTE", instant, to_local(instant, zone)).cast("int")


def _offset(instant: Column, zone: Column, between: str) -> Column:
    m = offset_minutes(instant, zone)
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(F.when(m < 0, "-").otherwise("+"), two(F.floor(F.abs(m) / 60)), F.lit(between), two(F.abs(m) % 60))


def iso_text(instant: Column, zone: Column) -> Column:
    """Date and minute with the offset, as 2026-07-10T09:30-04:00."""
    return F.concat(F.date_format(to_local(instant, zone), "yyyy-MM-dd'T'HH:mm"), _offset(instant, zone, ":"))


def display_text(instant: Column, zone: Column) -> Column:
    """Date and second with offset and zone, as 2026-07-10 09:30:00-0400 America/New_York."""
    return F.concat(F.date_format(to_local(instant, zone), "yyyy-MM-dd HH:mm:ss"), _offset(instant, zone, ""), F.lit(" "), zone)


def compact_text(instant: Column, zone: Column) -> Column:
    """Date and minute with the zone's name."""
    return F.concat(F.date_format(to_local(instant, zone), "yyyy-MM-dd HH:mm"), F.lit(" "), zone)
