"""Speaker turns from timed units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turns(units: DataFrame, by: Sequence[str], merge_gap: float, speaker: str = "speaker") -> DataFrame:
    """Units (by, id, start, end, speaker) merged into turns: neighbours of one speaker whose start is within merge_gap of the turn's end so far.

    Another speaker in between ends a turn. Units are ordered by start, end and id.
    """
    order = Window.partitionBy(*by).orderBy("start", "end", "id")
    changed = F.lag(speaker).over(order)
    runs = units.withColumn("__run", F.sum(F.when(changed.eqNullSafe(F.col(speaker)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*by, "__run").orderBy("start", "end", "id")
    far = F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(far.isNull() | (F.col("start") - far > merge_gap), 1).otherwise(0)
    parts = runs.withColumn("__opens", opens).withColumn("__part", F.sum("__opens").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(*by, "__run", "__part", speaker).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("units")).drop("__run", "__part")


def talk_ratio(found: DataFrame, by: Sequence[str], speaker: str = "speaker") -> DataFrame:
    """Of each speaker of a timeline: number of turns, their length, and its share of all."""
    each = found.groupBy(*by, speaker).agg(F.count("*").alias("turns"), F.sum(F.col("end") - F.col("start")).alias("length"))
    return each.withColumn("talk_ratio", F.col("length") / F.sum("length").over(Window.partitionBy(*by)))


def speaker_summary(found: DataFrame, by: Sequence[str], least_speakers: int = 1, most_unlabeled: float = 0.2, unknown: str = "unknown") -> DataFrame:
    """One row a timeline: known speakers, total and unlabeled length, and what blocks it."""
    length = F.col("end") - F.col("start")
    rows = found.groupBy(*by).agg(
        F.count("*").alias("turns"),
        F.count_distinct(F.when(F.col("speaker") != unknown, F.col("speaker"))).alias("speakers"),
        F.sum(length).alias("length"),
        F.sum(F.when(F.col("speaker") == unknown, length).otherwise(0)).alias("unlabeled"),
    )
    reasons = F.concat_ws(",", F.when(F.col("speakers") < least_speakers, "too_few_speakers"), F.when((F.col("length") > 0) & (F.col("unlabeled") > F.col("length") * most_unlabeled), "too_much_unlabeled"))
    return rows.withColumn("reasons", reasons).withColumn("status", F.when(F.col("reasons") != "", "blocked").otherwise("ready"))
