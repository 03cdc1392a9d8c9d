"""Timestamps as text and interval arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.numeric import _col


def to_ms(seconds: Column | str) -> Column:
    """Seconds to whole milliseconds, ties to even."""
    return F.bround(_col(seconds) * 1000, 0).cast("bigint")


def _clock(total_seconds: Column) -> list[Column]:
    return [
        F.floor(total_seconds / 3600).cast("bigint"),
        F.floor(F.pmod(total_seconds, F.lit(3600)) / 60).cast("bigint"),
        F.pmod(total_seconds, F.lit(60)),
    ]


def fmt_hms_ms_from_ms(ms: Column | str) -> Column:
    """`HH:MM:SS.mmm` of a millisecond count."""
    ms = _col(ms)
    seconds = F.floor(ms / 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", *_clock(seconds), F.pmod(ms, F.lit(1000)))


def fmt_hms_ms(seconds: Column | str, variant: str = "B", clamp: bool = False) -> Column:
    """`HH:MM:SS.mmm` of seconds.

    Variant B rounds to milliseconds first and is the default. A keeps the
    floored seconds and rounds only the fraction, so it can print `.1000`.
    C rounds the seconds within the minute, so it can print `60.000`.
    `clamp` treats negative times as 0.
    """
    seconds = _col(seconds)
    if clamp:
        seconds = F.greatest(seconds, F.lit(0.0))
    if variant == "B":
        return fmt_hms_ms_from_ms(to_ms(seconds))
    whole = F.floor(seconds).cast("bigint")
    if variant == "A":
        fraction = F.bround((seconds - whole) * 1000, 0).cast("bigint")
        return F.format_string("%02d:%02d:%02d.%03d", *_clock(whole), fraction)
    if variant == "C":
        hours, minutes, _ = _clock(whole)
        within = F.bround((seconds - F.floor(seconds / 60) * 60) * 1000, 0).cast("bigint")
        return F.format_string(
            "%02d:%02d:%02d.%03d", hours, minutes, F.floor(within / 1000).cast("bigint"), F.pmod(within, F.lit(1000))
        )
    raise ValueError(f"unknown timestamp variant {variant!r}")


def fmt_ms(seconds: Column | str) -> Column:
    """`MM:SS`; minutes run past 59."""
    whole = F.floor(_col(seconds)).cast("bigint")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("bigint"), F.pmod(whole, F.lit(60)))


def fmt_hms(seconds: Column | str) -> Column:
    """`HH:MM:SS` truncated; NULL prints zero."""
    whole = F.coalesce(F.floor(_col(seconds)).cast("bigint"), F.lit(0).cast("bigint"))
    return F.format_string("%02d:%02d:%02d", *_clock(whole))


def overlap(a0: Column | str, a1: Column | str, b0: Column | str, b1: Column | str) -> Column:
    """Length of the common part of two intervals, at least 0."""
    return F.greatest(F.lit(0), F.least(_col(a1), _col(b1)) - F.greatest(_col(a0), _col(b0)))


def duration(start: Column | str, end: Column | str, clamp: bool = True) -> Column:
    length = _col(end) - _col(start)
    return F.greatest(F.lit(0), length) if clamp else length
