"""Time columns. Epoch seconds become wall-clock ``TIMESTAMP_NTZ`` values in
an explicit zone, so results never depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col


#: Epoch seconds of 0001-01-02 and 9999-12-30.
YEARS = (-62_135_510_400, 253_402_128_000)


def _epoch_ntz() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def ntz_to_epoch(c) -> Column:
    """Wall-clock ``TIMESTAMP_NTZ`` read as UTC -> whole epoch seconds (floor)."""
    return F.timestamp_diff("SECOND", _epoch_ntz(), as_col(c))


def to_ts(epoch, tz: str = "UTC") -> Column:
    """Epoch seconds -> local wall-clock time in ``tz`` (TIMESTAMP_NTZ); NULL where
    the time lies outside the years 1 to 9999, with a day to spare for the zone."""
    sound = as_col(epoch).between(*YEARS)
    utc = F.timestamp_add("SECOND", F.when(sound, as_col(epoch)), _epoch_ntz())
    if tz.upper() in ("UTC", "Z", "GMT", "+00:00"):
        return utc
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def hour_of(epoch, tz: str = "UTC") -> Column:
    return F.hour(to_ts(epoch, tz))


def hour_label(hour) -> Column:
    """Hour ``h`` -> ``"hh-(h+1)"``, e.g. 0 -> ``"00-01"``, 23 -> ``"23-24"``."""
    h = as_col(hour)
    return F.format_string("%02d-%02d", h, h + 1)


def hour_block(epoch, tz: str = "UTC") -> Column:
    return hour_label(hour_of(epoch, tz))


def weekday(ts) -> Column:
    """Short weekday name, ``Sun`` .. ``Sat``."""
    return F.date_format(as_col(ts), "E")


def weekday_index(ts) -> Column:
    """Sort key for :func:`weekday`: 1 = Sunday .. 7 = Saturday."""
    return F.dayofweek(as_col(ts))


def to_day(ts) -> Column:
    return F.to_date(as_col(ts))
