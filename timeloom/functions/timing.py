"""Time codes, decibels and guarded numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm; never below zero, halves of a millisecond to even."""
    ms = F.bround(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    part = lambda unit, modulus: F.pmod(F.floor(ms / unit), F.lit(modulus))
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), part(60000, 60), part(1000, 60), F.pmod(ms, F.lit(1000)))


def parse_srt_time(text: Column) -> Column:
    """Seconds of a time code, or null."""
    pattern = r"(?U)^\s*(\d+):(\d{2}):(\d{2})[,.](\d{3})\s*$"
    part = lambda n: F.regexp_extract(text, pattern, n).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000


def parse_db(text: Column) -> Column:
    """-35dB as a number, or null."""
    return F.when(text.rlike(r"^-?\d+(\.\d+)?dB$"), F.regexp_extract(text, r"^(-?\d+(?:\.\d+)?)dB$", 1).try_cast("double"))


def format_db(value: Column) -> Column:
    return F.concat(F.bround(value).cast("int").cast("string"), F.lit("dB"))


def positive(value: Column) -> Column:
    """A number above zero, else null."""
    number = value.try_cast("double")
    return F.when(number > 0, number)


def realtime_factor(processing: Column, media: Column) -> Column:
    return F.when(media > 0, F.bround(processing / media, 6))


def dbfs(samples: Column, floor_rms: float = 0.0) -> Column:
    """Level of 16-bit samples against full scale: -100 for silence, or with the RMS taken as ``floor_rms`` at least."""
    square = F.aggregate(samples, F.lit(0.0), lambda sum_, x: sum_ + x.cast("double") * x.cast("double"))
    rms = F.greatest(F.sqrt(square / F.size(samples)), F.lit(floor_rms))
    return F.when(F.coalesce(F.size(samples), F.lit(0)) <= 0, -100.0).when(rms <= 0, -100.0).otherwise(20 * F.log10(rms / 32768.0))
