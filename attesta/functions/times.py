"""Epoch and calendar encodings of evidence formats as timestamp expressions.

Zero, null and values out of range give null, never an error.  Timestamps are UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_US = 1_000_000
# Microseconds between 1970-01-01 and each epoch, fixed values.
FILETIME_EPOCH_US = 11_644_473_600 * _US
MAC_EPOCH_US = 978_307_200 * _US
HFS_EPOCH_US = -2_082_844_800 * _US
OLE_EPOCH_DAYS = 25_569
# 0001-01-01 and 9999-12-31T23:59:59.999999 in microseconds.
_LOW, _HIGH = -62_135_596_800 * _US, 253_402_300_799 * _US + 999_999


def _micros(us: Column, zero: Column) -> Column:
    us = us.cast("long")
    return F.when((zero != 0) & us.between(_LOW, _HIGH), F.timestamp_micros(us))


def from_filetime(v: Column) -> Column:
    """100-nanosecond ticks since 1601; what is below a microsecond is dropped."""
    v = v.cast("decimal(20,0)")
    return _micros(F.when(v > 0, F.floor(v / 10) - F.lit(FILETIME_EPOCH_US)), v)


def from_webkit(v: Column) -> Column:
    """Microseconds since 1601."""
    return _micros(F.when(v > 0, v.cast("decimal(20,0)") - F.lit(FILETIME_EPOCH_US)), v)


def from_unix(v: Column, unit: str = "s") -> Column:
    """Seconds, milliseconds, microseconds or nanoseconds since 1970."""
    scale = {"s": F.lit(_US), "ms": F.lit(1000), "us": F.lit(1)}
    wide = v.cast("decimal(38,6)")
    return _micros(F.floor(wide / 1000) if unit == "ns" else F.floor(wide * scale[unit]), v)


def from_mac_absolute(v: Column) -> Column:
    """Seconds since 2001, with a fraction."""
    return _micros(F.floor(v.cast("decimal(38,6)") * _US) + F.lit(MAC_EPOCH_US), v)


def from_hfs(v: Column) -> Column:
    """Seconds since 1904."""
    return _micros(v.cast("decimal(38,0)") * _US + F.lit(HFS_EPOCH_US), v)


def from_ole_days(v: Column) -> Column:
    """Days since 1899-12-30, with a fraction."""
    return _micros(F.round((v.cast("double") - OLE_EPOCH_DAYS) * 86_400 * _US), v)


def from_dos(date: Column, time: Column) -> Column:
    """DOS date and time words; the zone is unknown, so the result carries none."""
    day, month, year = date.bitwiseAND(31), F.shiftright(date, 5).bitwiseAND(15), F.shiftright(date, 9).bitwiseAND(127) + 1980
    second, minute, hour = time.bitwiseAND(31) * 2, F.shiftright(time, 5).bitwiseAND(63), F.shiftright(time, 11).bitwiseAND(31)
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", year, month, day, hour, minute, second)
    return F.when(date != 0, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def at_utc(wall: Column) -> Column:
    """A time without zone as that time in UTC, whatever the session's zone is."""
    return F.from_utc_timestamp(wall.cast("timestamp"), F.current_timezone())


def to_iso(ts: Column) -> Column:
    """ISO-8601 text in UTC with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 as a double."""
    return F.unix_micros(ts) / F.lit(1e6)


def minute_of(ts: Column) -> Column:
    """Minutes since 1970, rounded down."""
    return F.floor(F.unix_micros(ts) / F.lit(60e6)).cast("long")
