"""Interval algebra on rows (keys..., start, end): half-open, any ordered number type.

Every operator takes the key columns that name a timeline. Work on one timeline is done in windows over its rows;
merge() can first merge within stretches of the timeline, so that a very long one isn't sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(by: Sequence[str], *order: str):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def islands(df: DataFrame, by: Sequence[str], gap: float = 0, start: str = "start", end: str = "end", island: str = "island") -> DataFrame:
    """df with the number of the merged interval that each row belongs to: a new one begins where start is more than gap after all ends before."""
    far = F.max(end).over(_before(by, start, end))
    opens = F.when(far.isNull() | (F.col(start) > far + gap), 1).otherwise(0)
    return df.withColumn("__opens", opens).withColumn(island, F.sum("__opens").over(Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0))).drop("__opens")


def merge(df: DataFrame, by: Sequence[str], gap: float = 0, start: str = "start", end: str = "end", stretch: float | None = None) -> DataFrame:
    """Merged intervals (by, start, end, pieces). Empty and reversed intervals are dropped, touching ones merge.

    stretch: rows are first merged within stretches of this length, which only leaves few rows of each timeline for the final merge.
    """
    rows = df.filter(F.col(end) > F.col(start)).select(*by, F.col(start).alias("start"), F.col(end).alias("end"), F.lit(1).cast("long").alias("pieces"))
    steps = [[*by, "__stretch"], list(by)] if stretch else [list(by)]
    for keys in steps:
        if "__stretch" in keys:
            rows = rows.withColumn("__stretch", F.floor(F.col("start") / stretch))
        rows = islands(rows, keys, gap).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("pieces").alias("pieces")).select(*by, "start", "end", "pieces")
    return rows


def gaps(df: DataFrame, by: Sequence[str], least: float = 0, start: str = "start", end: str = "end") -> DataFrame:
    """What no interval covers between the first start and the last end of a timeline, if longer than least."""
    far = F.max(end).over(_before(by, start, end))
    found = df.filter(F.col(end) > F.col(start)).withColumn("__far", far)
    return found.filter(F.col(start) - F.col("__far") > least).select(*by, F.col("__far").alias("start"), F.col(start).alias("end"))


def complement(df: DataFrame, lengths: DataFrame, by: Sequence[str], length: str = "duration", start: str = "start", end: str = "end") -> DataFrame:
    """What no interval covers from 0 to the length of each timeline in lengths (by, length). Empty and reversed intervals cover nothing, and a key that is null names a timeline as any other."""
    clip = lambda c: F.greatest(F.lit(0), F.least(c, F.col("__length")))
    ends = lengths.select(*by, F.col(length).alias("__length"))
    covered = df.filter(F.col(end) > F.col(start)).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(by)), F.col(start).alias("__s"), F.col(end).alias("__e"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)])
    rows = ends.join(covered, same, "left").select(*by, "__length", clip(F.col("__s")).alias("__s"), clip(F.col("__e")).alias("__e"))
    tail = ends.select(*by, "__length", F.col("__length").alias("__s"), F.col("__length").alias("__e"))
    cursor = F.coalesce(F.max("__e").over(_before(by, "__s", "__e")), F.lit(0))
    return rows.filter("__s IS NOT NULL").unionByName(tail).withColumn("__c", cursor).filter("__s > __c").select(*by, F.col("__c").alias("start"), F.col("__s").alias("end")).distinct()


def keep_segments(removed: DataFrame, lengths: DataFrame, by: Sequence[str], pad: float = 0, least: float = 0, length: str = "duration") -> DataFrame:
    """What stays of each timeline when removed intervals, each made smaller by pad on both sides, go; pieces shorter than least go too."""
    ends = lengths.select(*by, F.col(length).alias("__length"))
    cut = removed.join(ends, list(by)).select(*by, (F.col("start") + pad).alias("__s"), F.least(F.col("__length"), F.col("end") - pad).alias("__e"))
    tail = ends.select(*by, F.col("__length").alias("__s"), F.col("__length").alias("__e"))
    rows = cut.filter("__e > __s").unionByName(tail)
    cursor = F.coalesce(F.max("__e").over(_before(by, "__s", "__e")), F.lit(0))
    return rows.withColumn("__c", cursor).filter((F.col("__s") - F.col("__c") >= least) & (F.col("__s") > F.col("__c"))).select(*by, F.col("__c").alias("start"), F.col("__s").alias("end")).distinct()


def cut_plan(removed: DataFrame, lengths: DataFrame, by: Sequence[str], most_removed: float = 0.2, pad: float = 0, least: float = 0, allow_over: bool = False) -> DataFrame:
    """One row a timeline: kept and removed length, share removed, and whether the removal is within its budget."""
    kept = keep_segments(removed, lengths, by, pad, least).groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("kept"), F.count("*").alias("pieces"))
    plan = lengths.join(kept, list(by), "left").na.fill(0, ["kept", "pieces"]).withColumn("removed", F.col("duration") - F.col("kept"))
    over = F.col("removed") > F.col("duration") * most_removed
    return plan.withColumn("status", F.when(over & F.lit(not allow_over), "blocked").when(over, "review").otherwise("ready"))


def consecutive(points: DataFrame, lengths: DataFrame, by: Sequence[str], at: str = "at", length: str = "duration") -> DataFrame:
    """Timelines cut at points: (by, number, start, end) of the contiguous pieces from 0 to the length."""
    inside = points.join(lengths, list(by)).filter((F.col(at) > 0) & (F.col(at) < F.col(length))).select(*by, F.col(at).alias("__at"))
    marks = inside.unionByName(lengths.select(*by, F.lit(0).cast("long").alias("__at"))).unionByName(lengths.select(*by, F.col(length).alias("__at"))).distinct()
    w = Window.partitionBy(*by).orderBy("__at")
    return marks.withColumn("end", F.lead("__at").over(w)).withColumn("number", F.row_number().over(w)).filter("end IS NOT NULL").select(*by, "number", F.col("__at").alias("start"), "end")


def longest_run(df: DataFrame, by: Sequence[str], order: Sequence[str], flag: Column, weight: Column | None = None) -> DataFrame:
    """(by, run, rows): the largest total weight (rows, if none is given) of neighbouring rows for which flag holds; 0 without any."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("__flag", F.coalesce(flag, F.lit(False))).withColumn("__weight", weight if weight is not None else F.lit(1))
    marked = marked.withColumn("__run", F.sum(F.when(F.col("__flag"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*by, "__run").agg(F.sum(F.when(F.col("__flag"), F.col("__weight")).otherwise(0)).alias("run"), F.sum(F.col("__flag").cast("long")).alias("rows"))
    return runs.groupBy(*by).agg(F.max(F.struct("run", "rows")).alias("best")).select(*by, "best.run", "best.rows")


def local_spikes(df: DataFrame, by: Sequence[str], order: Sequence[str], score: str, width: int = 2, least_ratio: float = 3.0, least_score: float = 0.15, most_ratio: float = 255.0) -> DataFrame:
    """Rows whose score is least_ratio times the mean of width neighbours on either side; the first and last width rows have none."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-width, width)
    around = (F.sum(score).over(w) - F.col(score)) / (2 * width)
    rows = df.filter(F.col(score) >= 0).withColumn("local_average", F.when(F.count("*").over(w) == 2 * width + 1, around)).filter("local_average IS NOT NULL")
    ratio = F.when(F.col("local_average") < 1e-9, F.when(F.col(score) >= least_score, most_ratio).otherwise(0.0)).otherwise(F.least(F.col(score) / F.col("local_average"), F.lit(most_ratio)))
    return rows.withColumn("ratio", ratio).filter((F.col(score) >= least_score) & (F.col("ratio") >= least_ratio))
