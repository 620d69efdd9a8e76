"""Checks of claims, references, encodings, patches and measurements; each gives findings in the schema of operators.findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft.operators.findings import finding, report


def measured(rows: DataFrame, keys: Sequence[str], target: float, tolerance: float, most_peak: float, most_range: float, most_silence: float) -> DataFrame:
    """Loudness findings of rows (integrated, peak, range, longest_silence)."""
    off = F.abs(F.col("integrated") - target)
    return report(
        rows,
        keys,
        [
            finding(F.col("integrated").isNull(), "not_measured", "block", F.lit(None), None),
            finding(off > 2 * tolerance, "loudness", "block", F.col("integrated"), target),
            finding((off > tolerance) & (off <= 2 * tolerance), "loudness", "warn", F.col("integrated"), target),
            finding(F.col("peak") > most_peak, "true_peak", "block", F.col("peak"), most_peak),
            finding(F.col("range") > most_range, "loudness_range", "warn", F.col("range"), most_range),
            finding(F.col("longest_silence") > most_silence, "long_silence", "warn", F.col("longest_silence"), most_silence),
        ],
    )


def encoded(rows: DataFrame, keys: Sequence[str], codecs: Sequence[str], most_bytes: int, rate_tolerance: float = 0.01) -> DataFrame:
    """Findings of outputs (codec, width, height, fps, bytes, duration) against what was asked for (want_width, want_height, want_fps, want_duration)."""
    return report(
        rows,
        keys,
        [
            finding(~F.col("codec").isin(*codecs), "codec", "block", F.lit(None), None),
            finding((F.col("width") != F.col("want_width")) | (F.col("height") != F.col("want_height")), "size", "block", F.col("width"), None),
            finding(F.abs(F.col("fps") - F.col("want_fps")) > rate_tolerance, "rate", "block", F.col("fps"), None),
            finding(F.col("bytes") > most_bytes, "too_large", "block", F.col("bytes"), most_bytes),
            finding(F.abs(F.col("duration") - F.col("want_duration")) > 0.1, "duration", "warn", F.col("duration"), None),
        ],
    )


def bitrate(bytes_allowed: Column, duration: Column, audio: int, safety: float = 0.95) -> Column:
    """Bits a second for video so that all fits; null without a duration."""
    return F.when(duration > 0, F.floor(bytes_allowed * 8 * safety / duration) - audio)


def framed(rows: DataFrame, keys: Sequence[str], ratio: float, tolerance: float, least_edge: int) -> DataFrame:
    """Findings of pictures (width, height, alpha) that should have an aspect, e.g. as references."""
    own = F.col("width") / F.col("height")
    turned = ((own > 1) != F.lit(ratio > 1)) & F.lit(ratio != 1)
    return report(
        rows,
        keys,
        [
            finding(turned, "orientation", "block", own, ratio),
            finding(~turned & (F.abs(own / ratio - 1) > tolerance), "aspect", "warn", own, ratio),
            finding(F.least("width", "height") < least_edge, "too_small", "warn", F.least("width", "height"), least_edge),
            finding(F.coalesce(F.col("alpha"), F.lit(False)), "alpha", "warn", F.lit(None), None),
        ],
    )


def evidenced(claims: DataFrame, keys: Sequence[str], need_screenshot: bool, need_primary: bool) -> DataFrame:
    """Findings of claims (text, source_url, source_file, source_type, screenshot): without text or source, without a proper URL, or without what is asked for."""
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    checks = [
        finding(empty("text"), "no_text", "block", F.lit(None), None),
        finding(empty("source_url") & empty("source_file"), "no_source", "block", F.lit(None), None),
        finding(~empty("source_url") & ~F.col("source_url").rlike("^https?://[^/]+"), "bad_url", "block", F.lit(None), None),
    ]
    if need_screenshot:
        checks.append(finding(empty("screenshot"), "no_screenshot", "block", F.lit(None), None))
    if need_primary:
        checks.append(finding(~F.coalesce(F.col("source_type") == "primary", F.lit(False)), "not_primary", "warn", F.lit(None), None))
    return report(claims, keys, checks)


def patched(patches: DataFrame, segments: DataFrame, by: Sequence[str], most_chars: int) -> DataFrame:
    """Findings of patches (by, patch_id, segment_id, start, before, after) to the texts of segments (by, id, text): the text must stand where it is said to, and numbers must stay."""
    rows = patches.join(segments.select(*by, F.col("id").alias("segment_id"), F.col("text").alias("__text")), [*by, "segment_id"], "left")
    numbers = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0))
    there = F.substring(F.col("__text"), F.col("start") + 1, F.length("before")) == F.col("before")
    known = F.col("__text").isNotNull()
    return report(
        rows,
        [*by, "patch_id"],
        [
            finding(~known, "unknown_segment", "block", F.lit(None), None),
            finding(known & ~there, "span_differs", "block", F.col("start"), None),
            finding(F.col("before") == F.col("after"), "no_change", "block", F.lit(None), None),
            finding(~(numbers("before") == numbers("after")), "numbers_changed", "block", F.lit(None), None),
            finding(F.abs(F.length("after") - F.length("before")) > most_chars, "too_much_changed", "warn", F.length("after"), most_chars),
        ],
    )


def scored(reviews: DataFrame, weights: dict[str, float], ready: float = 80, review: float = 65) -> DataFrame:
    """reviews with the weighted score of their columns and its verdict; null where one is missing or out of 0 to 100."""
    valid = F.lit(True)
    total = F.lit(0.0)
    for name, w in weights.items():
        valid = valid & F.col(name).between(0, 100)
        total = total + F.col(name) * w
    score = F.when(F.coalesce(valid, F.lit(False)), total / sum(weights.values()))
    return reviews.withColumn("score", score).withColumn("verdict", F.when(F.col("score").isNull(), "invalid").when(F.col("score") >= ready, "ready").when(F.col("score") >= review, "review").otherwise("blocked"))
