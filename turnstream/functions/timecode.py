"""Timecodes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_timestamp(seconds: Column) -> Column:
    """[HH:MM:SS] of whole seconds, 0 at least; hours grow past two digits; null stays null."""
    s = F.greatest(F.floor(seconds), F.lit(0))
    return F.when(seconds.isNotNull(), F.format_string("[%02d:%02d:%02d]", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def parse_timestamp(ts: Column) -> Column:
    """Seconds of a strict [HH:MM:SS], else null; minutes and seconds are not range-checked, hours too large to count are null."""
    part = lambda at, size: F.substr(ts, F.lit(at), size).try_cast("long")
    hours = part(2, F.char_length(ts) - 8)
    return F.when(ts.rlike(r"^\[[0-9]{2,}:[0-9]{2}:[0-9]{2}\]\z"), F.try_add(F.try_multiply(hours, F.lit(3600)), part(-6, F.lit(2)) * 60 + part(-3, F.lit(2))))


def clock(seconds: Column) -> Column:
    """H:MM:SS, or M:SS below an hour; whole seconds, 0 at least."""
    s = F.greatest(F.when(seconds < 0, F.ceil(seconds)).otherwise(F.floor(seconds)), F.lit(0))
    h, m = F.floor(s / 3600), F.floor(s / 60)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m % 60, s % 60)).when(seconds.isNotNull(), F.format_string("%d:%02d", m, s % 60))


def precise_clock(seconds: Column, separator: str) -> Column:
    """HH:MM:SS and milliseconds after the separator, rounded, 0 at least."""
    ms = F.greatest(F.round(seconds * 1000).cast("long"), F.lit(0))
    s = F.floor(ms / 1000)
    return F.when(seconds.isNotNull(), F.format_string(f"%02d:%02d:%02d{separator}%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000))


def shift_timestamp(ts: Column, seconds: Column) -> Column:
    """A strict timestamp moved by whole seconds, not below 0; any other value as it is."""
    return F.coalesce(format_timestamp(parse_timestamp(ts) + seconds), ts)


def normalise_timestamp(ts: Column) -> Column:
    """Loose H:M:S, with both brackets or none, as [HH:MM:SS]; any other value trimmed."""
    bare = F.trim(ts)
    inner = F.regexp_replace(bare, r"^\[(.*)\]$", "$1")
    shape = r"^([0-9]{1,9}):([0-9]{1,2}):([0-9]{1,2})$"
    part = lambda k: F.regexp_extract(inner, shape, k).cast("int")
    return F.when(inner.rlike(shape), F.format_string("[%02d:%02d:%02d]", part(1), part(2), part(3))).otherwise(bare)
