"""Running values over timelines of any length: a timeline is cut into ranges, each range is summed up, the sums are carried on, and each range is read again.

`cut` lays the rows out by ranges of (timeline, order) and writes them, so that a timeline with a third of all rows lies in about a third of the
ranges. `running` computes running maxima, minima, sums and last values: within each range in a window of its own, across ranges from one row
for each range and timeline. No task holds a whole timeline; the windows in intervals, turns and joins give the same rows in one task a timeline.

Cases: null keys are a timeline of their own; null values add nothing; rows that tie in the whole order come in any order, as in those windows. Without rows there is no range and no row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.operators.graph import cut_lineage

#: Sums of ranges may be broadcast up to so many rows.
BROADCAST_ROWS = 1 << 17
PART = "__part"


@dataclass(frozen=True)
class Running:
    """A running max, min, sum or last of value; before: without the row itself."""

    kind: str
    value: Column
    before: bool = False


def cut(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], parts: int | None = None) -> DataFrame:
    """df with the number of the range that each row lies in, written."""
    ranges = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(ranges, *by, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def _both(kind: str, a: Column, b: Column) -> Column:
    if kind == "last":
        return F.coalesce(b, a)
    if kind == "sum":
        return F.coalesce(a + b, a, b)
    return (F.greatest if kind == "max" else F.least)(a, b)


def running(laid: DataFrame, by: Sequence[str], order: Sequence[Column | str], **wanted: Running) -> DataFrame:
    """laid (see cut) with a column for each of wanted. by may have more columns than laid was cut by, as long as rows of a timeline keep their order."""
    range_of = Window.partitionBy(*by, PART).orderBy(*order)
    rows, whole, carried = laid, [], []
    for name, w in wanted.items():
        rows = rows.withColumn(f"__v_{name}", w.value)
    rows = rows.withColumn("__n", F.row_number().over(range_of))
    for name, w in wanted.items():
        value = F.col(f"__v_{name}")
        if w.kind == "last":
            whole.append(F.max(F.when(value.isNotNull(), F.struct("__n", value.alias("v")))).alias(f"__s_{name}"))
        else:
            whole.append({"max": F.max, "min": F.min, "sum": F.sum}[w.kind](value).alias(f"__s_{name}"))
    sums = rows.groupBy(*by, PART).agg(*whole)
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    for name, w in wanted.items():
        s = F.col(f"__s_{name}")
        over = {"max": F.max(s), "min": F.min(s), "sum": F.sum(s), "last": F.last(s["v"], ignorenulls=True) if w.kind == "last" else s}[w.kind]
        carried.append(over.over(before).alias(f"__c_{name}"))
    carry = cut_lineage(sums.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate([*by, PART])), *carried), "carried")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*by, PART])])
    few = carry.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(carry) if few else carry, same)
    for name, w in wanted.items():
        frame = range_of.rowsBetween(Window.unboundedPreceding, -1 if w.before else 0)
        value = F.col(f"__v_{name}")
        own = {"max": F.max(value), "min": F.min(value), "sum": F.sum(value), "last": F.last(value, ignorenulls=True)}[w.kind].over(frame)
        joined = joined.withColumn(name, _both(w.kind, F.col(f"__c_{name}"), own))
    return joined.select(*laid.columns, *wanted)


def islands(df: DataFrame, by: Sequence[str], gap: float = 0, start: str = "start", end: str = "end", island: str = "island", parts: int | None = None) -> DataFrame:
    """As intervals.islands: df with the number of the merged interval that each row belongs to."""
    order = [start, end]
    laid = running(cut(df, by, order, parts), by, order, __far=Running("max", F.col(end), before=True))
    opens = F.when(F.col("__far").isNull() | (F.col(start) > F.col("__far") + gap), 1).otherwise(0)
    numbered = running(cut_lineage(laid.withColumn("__opens", opens), "opened"), by, order, **{island: Running("sum", F.col("__opens"))})
    return numbered.drop("__far", "__opens", PART)


def gaps(df: DataFrame, by: Sequence[str], least: float = 0, start: str = "start", end: str = "end", parts: int | None = None) -> DataFrame:
    """As intervals.gaps: what no interval covers between the first start and the last end of a timeline, if longer than least."""
    order = [start, end]
    found = running(cut(df.filter(F.col(end) > F.col(start)).select(*by, start, end), by, order, parts), by, order, __far=Running("max", F.col(end), before=True))
    return found.filter(F.col(start) - F.col("__far") > least).select(*by, F.col("__far").alias("start"), F.col(start).alias("end"))


def merge(df: DataFrame, by: Sequence[str], gap: float = 0, start: str = "start", end: str = "end", parts: int | None = None) -> DataFrame:
    """As intervals.merge: merged intervals (by, start, end, pieces); empty and reversed intervals are dropped, touching ones merge."""
    rows = df.filter(F.col(end) > F.col(start)).select(*by, F.col(start).alias("start"), F.col(end).alias("end"))
    return islands(rows, by, gap, parts=parts).groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("pieces")).drop("island")


def turns(units: DataFrame, by: Sequence[str], merge_gap: float, speaker: str = "speaker", parts: int | None = None) -> DataFrame:
    """As turns.turns: neighbours of one speaker whose start is within merge_gap of the turn's end so far."""
    order, run = ["start", "end", "id"], [*by, "__run"]
    laid = running(cut(units, by, order, parts), by, order, __before=Running("last", F.struct(F.col(speaker).alias("who")), before=True))
    changed = F.when(F.col("__before").isNull() | ~F.col("__before.who").eqNullSafe(F.col(speaker)), 1).otherwise(0)
    laid = running(cut_lineage(laid.withColumn("__changed", changed).drop("__before"), "changed"), by, order, __run=Running("sum", F.col("__changed")))
    laid = running(cut_lineage(laid, "runs"), run, order, __far=Running("max", F.col("end"), before=True))
    opens = F.when(F.col("__far").isNull() | (F.col("start") - F.col("__far") > merge_gap), 1).otherwise(0)
    laid = running(cut_lineage(laid.withColumn("__opens", opens), "opened"), run, order, __turn=Running("sum", F.col("__opens")))
    found = laid.groupBy(*run, "__turn", speaker).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("units"))
    return found.drop("__run", "__turn")


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], at: str = "at", value: str = "at", tolerance: float | None = None, forward: bool = False, out: str = "matched", parts: int | None = None) -> DataFrame:
    """As joins.as_of: left with the last right.value at or before left.at (the first at or after it, if forward), if no farther than tolerance."""
    sides = left.withColumn("__from", F.lit(1)).withColumn("__at", F.col(at)).unionByName(right.select(*by, F.col(value).alias("__at"), F.col(value).alias("__value"), F.lit(0).alias("__from")), allowMissingColumns=True)
    order = [F.desc("__at") if forward else F.asc("__at"), F.asc("__from")]
    found = running(cut(sides, by, order, parts), by, order, **{out: Running("last", F.col("__value"))}).filter("__from = 1").drop("__from", "__at", "__value", PART)
    return found if tolerance is None else found.withColumn(out, F.when(F.abs(F.col(out) - F.col(at)) <= tolerance, F.col(out)))


def in_stretches(df: DataFrame, by: Sequence[str], start: Column, end: Column, choose: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """choose(rows, keys) over the stretches of each timeline that no row spans: rows of different stretches don't touch, so choices that only look at rows that meet are independent of each other.

    keys are by and stretch_no, the number of the stretch, from 1 in the order of time; what choose returns has them.
    """
    rows = df.withColumn("__start", start).withColumn("__end", end)
    return choose(islands(rows, by, 0, "__start", "__end", "stretch_no").drop("__start", "__end"), [*by, "stretch_no"])
