"""Findings: one schema for what every check reports, and its roll-up to a status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("kind", "severity", "value", "limit")


def finding(when: Column, kind: str, severity: str, value: Column, limit: float | None) -> Column:
    """A struct (kind, severity, value, limit) where `when` holds, else null. severity: block or warn."""
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), value.cast("double").alias("value"), F.lit(limit).cast("double").alias("limit")))


def report(df: DataFrame, keys: Sequence[str], checks: Sequence[Column]) -> DataFrame:
    """One row (keys, kind, severity, value, limit) for each check that found something."""
    return df.select(*keys, F.inline(F.array_compact(F.array(*checks))))


def summary(found: DataFrame, subjects: DataFrame, by: Sequence[str], warn: str = "review") -> DataFrame:
    """(by, blocking, warnings, status) for each subject, those without findings too. status: blocked, review (or another word for it), ready."""
    counts = found.groupBy(*by).agg(F.count_if(F.col("severity") == "block").alias("blocking"), F.count_if(F.col("severity") == "warn").alias("warnings"))
    each = subjects.select(*by).distinct().join(counts, list(by), "left").na.fill(0, ["blocking", "warnings"])
    return each.withColumn("status", F.when(F.col("blocking") > 0, "blocked").when(F.col("warnings") > 0, warn).otherwise("ready"))


def cue_checks(cues: DataFrame, by: Sequence[str], optimal: float = 18, most: float = 25, flash: int = 150, short: int = 500, long: int = 7000, most_lines: int = 2, most_chars: int = 42, length: Column | None = None) -> DataFrame:
    """Readability findings of cues (by, id, start, end, text; times in milliseconds), in file order of id."""
    order = Window.partitionBy(*by).orderBy("id")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    visible = F.length(F.array_join(lines, ""))
    rows = cues.withColumn("__before", F.lag("start").over(order)).withColumn("__far", F.max("end").over(Window.partitionBy(*by).orderBy("start", "end", "id").rowsBetween(Window.unboundedPreceding, -1)))
    duration = F.col("end") - F.col("start")
    timed = duration > 0
    cps = visible * 1000 / duration
    longest = F.array_max(F.transform(lines, F.length))
    checks = [
        finding(F.col("start") < 0, "negative_start", "block", F.col("start"), 0),
        finding(~timed, "non_positive_duration", "block", duration, flash),
        finding(F.col("start") < F.col("__before"), "non_monotonic_order", "block", F.col("start"), None),
        finding(F.coalesce(visible, F.lit(0)) == 0, "empty_text", "block", F.lit(None), None),
        finding(timed & (duration < flash), "flash_cue", "block", duration, flash),
        finding((duration >= flash) & (duration < short), "short_duration", "warn", duration, short),
        finding(duration > long, "long_duration", "warn", duration, long),
        finding(timed & (cps > most), "cps_over_max", "block", cps, most),
        finding(timed & (cps > optimal) & (cps <= most), "cps_high", "warn", cps, optimal),
        finding(F.size(lines) > most_lines, "too_many_lines", "warn", F.size(lines), most_lines),
        finding(longest > most_chars, "line_too_long", "warn", longest, most_chars),
        finding(timed & (F.col("start") < F.col("__far")), "cue_overlap", "block", F.col("__far") - F.col("start"), 0),
    ]
    if length is not None:
        checks.append(finding(F.col("end") > length, "media_out_of_bounds", "block", F.col("end"), None))
    return report(rows, [*by, "id"], checks)


def rhythm(shots: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of the shots (by, start, end) of each timeline: number, mean, median, 90th percentile (nearest rank), variation, share of short ones."""
    d = F.col("end") - F.col("start")
    return shots.withColumn("d", d).groupBy(*by).agg(
        F.count("*").alias("shots"),
        F.avg("d").alias("mean"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d)").cast("double").alias("median"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY d)").cast("double").alias("p90"),
        F.coalesce(F.when(F.count("*") > 1, F.stddev_pop("d") / F.nullif(F.avg("d"), F.lit(0.0))), F.lit(0.0)).alias("variation"),
        (F.count_if(F.col("d") < 1000) / F.count("*")).alias("short_share"),
    )


def phase_thirds(boundaries: DataFrame, lengths: DataFrame, by: Sequence[str], at: str = "at", length: str = "duration") -> DataFrame:
    """(by, phase, n): how many boundaries lie in each third of a timeline; the end counts with the last."""
    third = F.least(F.lit(2), F.floor(F.col(at) * 3 / F.col(length)))
    return boundaries.join(lengths, list(by)).withColumn("phase", third.cast("int")).groupBy(*by, "phase").agg(F.count("*").alias("n"))


def motion_guard(segments: DataFrame, by: Sequence[str], least_motion: float = 0.5, most_still: int = 8000) -> DataFrame:
    """Share of motion and longest still run of segments (by, start, end, kind in motion, still, unknown), with what blocks."""
    from chronoweft.operators.intervals import longest_run

    d = F.col("end") - F.col("start")
    total = segments.groupBy(*by).agg(F.sum(d).alias("length"), F.sum(F.when(F.col("kind") == "motion", d).otherwise(0)).alias("motion"))
    still = longest_run(segments, by, ["start", "end"], F.col("kind").isin("still", "unknown"), d).select(*by, F.col("run").alias("still_run"))
    each = total.join(still, list(by))
    return each.withColumn("status", F.when(F.col("motion") < F.col("length") * least_motion, "blocked").when(F.col("still_run") > most_still, "review").otherwise("ready"))
