"""Clock arithmetic on timestamp_ntz columns that hold UTC. Differences assume the session time zone UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def from_micros(x: Column) -> Column:
    return F.timestamp_micros(x).cast("timestamp_ntz")


def plus_minutes(t: Column, minutes: Column | int) -> Column:
    n = F.lit(minutes) if isinstance(minutes, int) else minutes
    return from_micros(micros(t) + n.cast("long") * 60_000_000)


def minutes_between(a: Column, b: Column) -> Column:
    """Minutes from a to b, as a double."""
    return (micros(b) - micros(a)) / F.lit(60_000_000.0)


def to_local(t: Column, zone: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), zone, t)


def to_utc(t: Column, zone: Column) -> Column:
    """Local wall clock to UTC by the named zone; a null zone gives null, so naive clocks are never guessed."""
    return F.convert_timezone(zone, F.lit("UTC"), t)


def seconds_of_day(t: Column) -> Column:
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def utc_text(t: Column) -> Column:
    """Canonical UTC text with microseconds."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def minute_end(t: Column) -> Column:
    return plus_minutes(F.date_trunc("minute", t.cast("timestamp")).cast("timestamp_ntz"), 1)
