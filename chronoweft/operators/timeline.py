"""Mapping of source ranges to an output timeline: edit lists, cues, speed ramps, audio handles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.functions import timecode


def _before(by: Sequence[str], *order: str):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def edit_events(segments: DataFrame, by: Sequence[str], order: Sequence[str], fps: int = 25) -> DataFrame:
    """Events (by, number, source and record frames) of segments in order, times in milliseconds; those without a frame are skipped."""
    rows = segments.withColumn("source_in", timecode.seconds_to_frames(F.col("start") / 1000, fps)).withColumn("source_out", timecode.seconds_to_frames(F.col("end") / 1000, fps)).filter("source_out > source_in")
    length = F.col("source_out") - F.col("source_in")
    rows = rows.withColumn("record_in", F.coalesce(F.sum(length).over(_before(by, *order)), F.lit(0))).withColumn("record_out", F.col("record_in") + length)
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).select(*by, "number", "source_in", "source_out", "record_in", "record_out")


def edit_list_lines(events: DataFrame, reel: Column, fps: int = 25) -> DataFrame:
    """events with `line`, the text of each in an edit decision list; numbers have three digits at least."""
    number = F.col("number").cast("string")
    codes = [timecode.timecode(F.col(c), fps) for c in ("source_in", "source_out", "record_in", "record_out")]
    return events.withColumn("line", F.concat_ws(" ", F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0")), F.rpad(reel, 8, " "), F.lit("V     C       "), *codes))


def reel_name(path: Column) -> Column:
    """Eight capitals and digits from the file name without ending; AX where nothing is left."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    name = F.substring(F.upper(F.regexp_replace(stem, "[^A-Za-z0-9]", "")), 1, 8)
    return F.when(name == "", "AX").otherwise(name)


def output_times(clips: DataFrame, by: Sequence[str], order: Sequence[str], speed: Column, offset: int = 0) -> DataFrame:
    """clips (by, start, end in ms) with the output range that each has when they are played one after another at a speed, rounded down."""
    ends = F.sum((F.col("end") - F.col("start")) / speed).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    begins = F.coalesce(F.sum((F.col("end") - F.col("start")) / speed).over(_before(by, *order)), F.lit(0.0))
    return clips.withColumn("out_start", F.floor(begins) + offset).withColumn("out_end", F.floor(ends) + offset)


def curve(kind: Column, at: Column) -> Column:
    """Progress of a speed ramp at a position from 0 to 1: linear, ease, s_curve or snap."""
    return F.when(kind == "ease", (1 - F.cos(at * F.pi())) / 2).when(kind == "s_curve", at * at * (3 - 2 * at)).when(kind == "snap", F.when(at < 0.5, 0.0).otherwise(1.0)).otherwise(at)


def ramp_pieces(ramps: DataFrame, by: Sequence[str], steps: int) -> DataFrame:
    """Ramps (by, start, end, from_speed, to_speed, curve) as pieces of constant speed, with the output time where each begins."""
    k = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")
    rows = ramps.select("*", k)
    part = (F.col("end") - F.col("start")) / steps
    middle = (F.col("step") + 0.5) / steps
    rows = rows.withColumn("piece_start", F.col("start") + part * F.col("step")).withColumn("piece_end", F.col("start") + part * (F.col("step") + 1)).withColumn("speed", F.col("from_speed") + (F.col("to_speed") - F.col("from_speed")) * curve(F.col("curve"), middle))
    spent = (F.col("piece_end") - F.col("piece_start")) / F.col("speed")
    return rows.withColumn("out_start", F.coalesce(F.sum(spent).over(_before(by, "start", "step")), F.lit(0.0))).select(*by, "step", "piece_start", "piece_end", "speed", "out_start")


def speed_jumps(pieces: DataFrame, by: Sequence[str], order: Sequence[str], most: float) -> DataFrame:
    """Pieces whose speed differs from that before by more than most."""
    w = Window.partitionBy(*by).orderBy(*order)
    return pieces.withColumn("before", F.lag("speed").over(w)).filter(F.abs(F.col("speed") - F.col("before")) > most)


def proportional_cues(parts: DataFrame, by: Sequence[str], order: Sequence[str], start: str = "start", end: str = "end", text: str = "text") -> DataFrame:
    """Parts of texts of one range (by, start, end) with times in proportion to their characters; the last ends where the range does."""
    n = F.greatest(F.length(text), F.lit(1))
    w = Window.partitionBy(*by)
    total, before = F.sum(n).over(w), F.coalesce(F.sum(n).over(_before(by, *order)), F.lit(0))
    span = F.col(end) - F.col(start)
    last = F.row_number().over(w.orderBy(*order)) == F.count("*").over(w)
    return parts.withColumn("cue_start", F.col(start) + F.floor(span * before / total)).withColumn("cue_end", F.when(last, F.col(end)).otherwise(F.col(start) + F.floor(span * (before + n) / total)))


def neighbours(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, radius: int) -> DataFrame:
    """rows with the values of up to radius rows before and after, in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("before", F.collect_list(value).over(w.rowsBetween(-radius, -1))).withColumn("after", F.collect_list(value).over(w.rowsBetween(1, radius)))


def equal_groups(rows: DataFrame, by: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """rows with `group`: at most `most` groups of nearly equal count, row i of n in group floor(i * k / n)."""
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    return rows.withColumn("group", F.floor((F.row_number().over(w.orderBy(*order)) - 1) * F.least(n, F.lit(most)) / n).cast("int"))


def audio_handles(clips: DataFrame, by: Sequence[str], order: Sequence[str], lead: int, lag: int) -> DataFrame:
    """clips with the audio range that begins `lead` before and ends `lag` after the picture, not beyond the neighbours' middles or the first and last edge."""
    w = Window.partitionBy(*by).orderBy(*order)
    half = (F.col("out_end") - F.col("out_start")) / 2
    rows = clips.withColumn("__half", F.floor(half))
    first, last = F.lag("__half").over(w), F.lead("__half").over(w)
    return rows.withColumn("audio_start", F.col("out_start") - F.coalesce(F.least(first, F.lit(lead)), F.lit(0))).withColumn("audio_end", F.col("out_end") + F.coalesce(F.least(last, F.lit(lag)), F.lit(0))).drop("__half")
