"""Scalar keys derived from inventory columns, all JVM-side."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge import constants as C


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant(t: datetime | str | Column) -> Column:
    """A UTC point in time as a timestamp literal, whatever the session zone."""
    if isinstance(t, Column):
        return t
    if isinstance(t, str):
        t = datetime.fromisoformat(t)
    if t.tzinfo is None:
        t = t.replace(tzinfo=timezone.utc)
    return F.lit(t.astimezone(timezone.utc).isoformat()).cast("timestamp")


def machine_key(machine_type: Column | str) -> Column:
    """First two dash segments of the machine type."""
    return F.substring_index(as_column(machine_type), "-", 2)


def machine_class(machine_type: Column | str) -> Column:
    """First dash segment of the machine type."""
    return F.substring_index(as_column(machine_type), "-", 1)


def region_of_zone(zone: Column | str) -> Column:
    """The zone without its last dash segment; empty when there is only one."""
    z = as_column(zone)
    return F.when(F.instr(z, "-") > 0, F.regexp_replace(z, "-[^-]*$", "")).otherwise(
        F.when(z.isNotNull(), F.lit("")))


def disk_region(is_regional: Column | str, region: Column | str, zone: Column | str) -> Column:
    """Region a disk is priced in."""
    return F.when(as_column(is_regional), as_column(region)).otherwise(region_of_zone(zone))


def memory_gb(memory_mb: Column | str) -> Column:
    return as_column(memory_mb) / F.lit(1024)


def special_class(machine_type: Column | str) -> Column:
    """The machine type if licenses price it on its own, else NULL."""
    t = as_column(machine_type)
    return F.when(t.isin(*C.SMALL_MACHINE_CLASSES), t)


def num_gpu(accel: Column | str) -> Column:
    """Number of accelerator entries, not of devices."""
    return F.coalesce(F.size(as_column(accel)), F.lit(0))


def last_path_segment(url: Column | str) -> Column:
    return F.substring_index(as_column(url), "/", -1)


def parse_rfc3339(text: Column | str, strict: bool = True) -> Column:
    """Timestamp with fraction and offset; the offset may lack its colon. Not ``strict``: NULL instead of an error."""
    with_colon = F.regexp_replace(as_column(text), "([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    return with_colon.cast("timestamp") if strict else with_colon.try_cast("timestamp")


def hour_floor(ts: Column | str) -> Column:
    return F.date_trunc("hour", as_column(ts))


def month_floor(ts: Column | str) -> Column:
    return F.date_trunc("month", as_column(ts))


def iso_year(ts: Column | str) -> Column:
    """Year the ISO week belongs to."""
    return F.extract(F.lit("YEAROFWEEK"), as_column(ts))


def iso_week(ts: Column | str) -> Column:
    return F.weekofyear(as_column(ts))


def hours_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed hours with microsecond precision."""
    return (F.unix_micros(as_column(end)) - F.unix_micros(as_column(start))) / F.lit(3.6e9)


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed minutes with microsecond precision."""
    return (F.unix_micros(as_column(end)) - F.unix_micros(as_column(start))) / F.lit(6.0e7)


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed whole seconds, fractions cut off."""
    micros = F.unix_micros(as_column(end)) - F.unix_micros(as_column(start))
    return F.floor(micros / F.lit(1000000)).cast("bigint")


def extract_or_null(text: Column | str, pattern: str) -> Column:
    """First group of ``pattern``, NULL (not '') where it does not match."""
    t = as_column(text)
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1))


def money(c: Column | str) -> Column:
    """Exact decimal for sums that must not depend on row order."""
    return as_column(c).cast("decimal(28,9)")
