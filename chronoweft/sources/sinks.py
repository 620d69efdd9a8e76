"""Text formats as string columns: one text a key, from its cues or events in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.functions import timecode


def joined(rows: DataFrame, by: Sequence[str], order: Sequence[str], line: Column, separator: str, head: str = "", tail: str = "") -> DataFrame:
    """(by, text): the lines of each key in order, between head and tail."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("__line")))), lambda x: x["__line"]), separator)
    return rows.groupBy(*by).agg(F.concat(F.lit(head), body, F.lit(tail)).alias("text"))


def _numbered(cues: DataFrame, by: Sequence[str]) -> DataFrame:
    return cues.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("start", "end", "text")))


def srt(cues: DataFrame, by: Sequence[str]) -> DataFrame:
    """cues (by, start, end, text) in milliseconds as SRT."""
    line = F.concat(F.col("__n").cast("string"), F.lit("\n"), timecode.srt_time(F.col("start")), F.lit(" --> "), timecode.srt_time(F.col("end")), F.lit("\n"), F.col("text"))
    return joined(_numbered(cues, by), by, ["__n"], line, "\n\n", tail="\n")


def vtt(cues: DataFrame, by: Sequence[str]) -> DataFrame:
    line = F.concat(timecode.vtt_time(F.col("start")), F.lit(" --> "), timecode.vtt_time(F.col("end")), F.lit("\n"), F.col("text"))
    return joined(_numbered(cues, by), by, ["__n"], line, "\n\n", head="WEBVTT\n\n", tail="\n")


def ass_text(text: Column) -> Column:
    """Text with what starts commands escaped and line breaks as \\N."""
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    return F.replace(out, F.lit("\n"), F.lit("\\N"))


def ass_events(cues: DataFrame, by: Sequence[str], style: str = "Default") -> DataFrame:
    line = F.concat(F.lit("Dialogue: 0,"), timecode.ass_time(F.col("start")), F.lit(","), timecode.ass_time(F.col("end")), F.lit(f",{style},,0,0,0,,"), ass_text(F.col("text")))
    return joined(_numbered(cues, by), by, ["__n"], line, "\n")


def chapters(marks: DataFrame, by: Sequence[str]) -> DataFrame:
    """marks (by, start in ms, title) as a list of chapters."""
    return joined(marks, by, ["start", "title"], F.concat(timecode.chapter_time(F.floor(F.col("start") / 1000)), F.lit(" "), F.col("title")), "\n")


def timeline_json(events: DataFrame, by: Sequence[str], fps: int) -> DataFrame:
    """Events of an edit as a timeline document in JSON: clips in order with their source ranges."""
    time = lambda c: F.struct(F.lit(fps).alias("rate"), c.alias("value"))
    clip = F.struct("number", F.struct(time(F.col("source_out") - F.col("source_in")).alias("duration"), time(F.col("source_in")).alias("start_time")).alias("source_range"))
    clips = F.transform(F.sort_array(F.collect_list(clip)), lambda x: F.struct(F.lit("Clip").alias("kind"), x["number"].alias("name"), x["source_range"].alias("source_range")))
    return events.groupBy(*by).agg(F.to_json(F.struct(F.lit("Timeline").alias("kind"), clips.alias("clips"))).alias("text"))


def select_filter(segments: DataFrame, by: Sequence[str]) -> DataFrame:
    """Kept ranges (by, start, end in ms) as the expression of a media filter that selects them."""
    line = F.format_string("between(t,%.3f,%.3f)", F.col("start") / 1000, F.col("end") / 1000)
    return joined(segments, by, ["start", "end"], line, "+", head="select='", tail="'")
