"""Time and permission rendering from microseconds since the epoch."""

from __future__ import annotations

import logging
import re
import zoneinfo

from pyspark.sql import Column, functions as F

log = logging.getLogger(__name__)

_ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"
# fixed values: first and last instant of years 1 to 9999
_MIN_EPOCH = -62135596800
_MAX_EPOCH = 253402300799


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def utc_of_micros(micros: Column) -> Column:
    """Zone-less UTC timestamp, whatever the session time zone is."""
    return F.timestamp_add("MICROSECOND", micros, _epoch())


def micros_of(ts: Column) -> Column:
    """Microseconds of a zone-less timestamp taken as UTC."""
    return F.timestamp_diff("MICROSECOND", _epoch(), ts)


_OFFSET = "[+-][0-9]{2}:[0-9]{2}"


def known_zone(zone: str | Column) -> Column:
    """The zone where it is known, UTC for any other: an unknown name would fail the job."""
    names = zoneinfo.available_timezones()
    if isinstance(zone, str):
        if zone not in names and not re.fullmatch(_OFFSET, zone):
            log.warning("unknown time zone %r, UTC is used", zone)
            zone = "UTC"
        return F.lit(zone)
    return F.when(zone.isin(*sorted(names)) | zone.rlike(f"^{_OFFSET}$"), zone).otherwise("UTC")


def iso_micros(micros: Column, zone: str | Column = "UTC") -> Column:
    """ISO 8601 text with offset; a fraction only where it is not zero."""
    zone_col = known_zone(zone)
    utc = utc_of_micros(micros)
    local = F.convert_timezone(F.lit("UTC"), zone_col, utc)
    fraction = F.pmod(micros, F.lit(1_000_000)) != 0
    body = F.when(fraction, F.date_format(local, _ISO_SECONDS + ".SSSSSS")).otherwise(
        F.date_format(local, _ISO_SECONDS)
    )
    minutes = F.timestamp_diff("MINUTE", utc, local)
    size = F.abs(minutes)
    offset = F.concat(
        F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.floor(size / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((size % 60).cast("string"), 2, "0"),
    )
    return F.concat(body, offset)


def format_epoch(seconds: Column, zone: str | Column = "UTC") -> Column:
    """Numeric epoch seconds (or text holding them) to ISO text; '' when invalid or missing."""
    value = seconds.try_cast("double")
    usable = value.isNotNull() & ~F.isnan(value) & value.between(_MIN_EPOCH, _MAX_EPOCH)
    micros = F.rint(F.when(usable, value) * 1_000_000).cast("long")
    return F.coalesce(iso_micros(micros, zone), F.lit(""))


def permissions(mode: Column) -> Column:
    """``0o100644`` form of a stat mode."""
    return F.concat(F.lit("0o"), F.lower(F.conv(mode.cast("string"), 10, 8)))


def clock_time(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def run_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
