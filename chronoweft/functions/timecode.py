"""Frames, timecodes and times as text. Seconds are doubles or whole milliseconds, as each function says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_to_frames(seconds: Column, fps: int) -> Column:
    """Rounded half to even, 0 at least."""
    return F.greatest(F.lit(0), F.bround(seconds * fps)).cast("long")


def timecode(frames: Column, fps: int) -> Column:
    """HH:MM:SS:FF without dropped frames; from 100 hours on the hours have more digits."""
    two = lambda c: F.lpad(c.cast("string"), F.greatest(F.lit(2), F.length(c.cast("string"))), F.lit("0"))
    seconds = F.floor(frames / fps)
    return F.concat_ws(":", two(F.floor(seconds / 3600)), two(F.floor(seconds / 60) % 60), two(seconds % 60), two(frames % fps))


def _clock(ms: Column, hours: int, unit: int, digits: int, point: str) -> Column:
    whole = F.greatest(F.lit(0), ms).cast("long")
    whole = F.floor((whole + unit // 2) / unit) * unit if unit > 1 else whole
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    h, m, s = F.floor(whole / 3_600_000), F.floor(whole / 60_000) % 60, F.floor(whole / 1000) % 60
    left = F.greatest(F.length(h.cast("string")), F.lit(hours))
    return F.concat(F.lpad(h.cast("string"), left, F.lit("0")), F.lit(":"), pad(m, 2), F.lit(":"), pad(s, 2), F.lit(point), pad(F.floor((whole % 1000) / unit), digits))


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm of milliseconds."""
    return _clock(ms, 2, 1, 3, ",")


def vtt_time(ms: Column) -> Column:
    return _clock(ms, 2, 1, 3, ".")


def ass_time(ms: Column) -> Column:
    """H:MM:SS.cc of milliseconds, rounded to hundredths with carry."""
    return _clock(ms, 1, 10, 2, ".")


def chapter_time(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on, of seconds rounded down."""
    s = F.floor(F.greatest(F.lit(0), seconds))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(s >= 3600, F.concat_ws(":", F.floor(s / 3600), two(F.floor(s / 60) % 60), two(s % 60))).otherwise(F.concat_ws(":", F.floor(s / 60), two(s % 60)))


def parse_clock(text: Column) -> Column:
    """Seconds of `S`, `M:S` or `H:M:S`, with fractions; null if a part is no number."""
    return F.aggregate(F.split(F.trim(text), ":"), F.lit(0.0), lambda acc, x: acc * 60 + x.try_cast("double"))


def rational_time(seconds: Column, fps: int) -> Column:
    """Frames over rate as text, `0s` for nothing."""
    frames = seconds_to_frames(seconds, fps)
    return F.when(frames == 0, "0s").otherwise(F.concat(frames.cast("string"), F.lit(f"/{fps}s")))
