"""Stamps with and without a zone as instants, and local days. Nothing here depends on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def instant(stamp: Column, zone: str = "UTC") -> Column:
    """An ISO stamp as a timestamp: by its own zone (Z, +09:00) if it has one, else as local time of `zone`. Null where it is
    no stamp."""
    zoned = stamp.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    local = F.to_utc_timestamp(F.try_to_timestamp(F.concat(stamp, F.lit("Z"))), zone)
    return F.when(zoned, F.try_to_timestamp(stamp)).otherwise(local)


def seconds(at: Column) -> Column:
    """Whole seconds of an instant."""
    return F.floor(F.unix_micros(at.cast("timestamp")) / 1_000_000).cast("long")


def offset(at: Column, zone: str) -> Column:
    """Seconds by which local time in `zone` is ahead of UTC at an instant (a timestamp)."""
    return seconds(F.from_utc_timestamp(at, zone)) - seconds(at)


def local_midnight(at: Column, zone: str) -> Column:
    """The second at which the local day of an instant (in seconds) began in `zone`."""
    stamp = F.timestamp_seconds(at)
    local = at + offset(stamp, zone)
    start = local - F.pmod(local, F.lit(DAY))
    return start - offset(F.timestamp_seconds(start - offset(stamp, zone)), zone)


def local_stamp(at: Column, zone: str) -> Column:
    """Local time in `zone` of an instant (in seconds), to the second and without a zone: 2024-01-02T03:04:05."""
    local = at + offset(F.timestamp_seconds(at), zone)
    of_day = F.pmod(local, F.lit(DAY))
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    day = F.date_from_unix_date(F.floor(local / DAY).cast("int")).cast("string")
    return F.concat(day, F.lit("T"), two(of_day / 3600), F.lit(":"), two(of_day % 3600 / 60), F.lit(":"), two(of_day % 60))
