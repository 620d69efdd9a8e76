"""Readers of text formats with times: logs of media filters, speaker segments, subtitles. Seconds are doubles.

Log readers take rows (by, n, line): a line and its number within a log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NUMBER = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"


def _found(line: Column, pattern: str) -> Column:
    value = F.regexp_extract(line, pattern, 1)
    return F.when(value != "", value.try_cast("double"))


def detected_spans(lines: DataFrame, lengths: DataFrame, by: Sequence[str], begin: str, end: str, length: str = "duration") -> DataFrame:
    """(by, start, end) from lines that hold `<begin>: x` and `<end>: y`, e.g. silence_start and silence_end; what is open at the end of a log ends with the media."""
    w = Window.partitionBy(*by).orderBy("n")
    marks = lines.withColumn("s", _found(F.col("line"), rf"{begin}: *{_NUMBER}")).withColumn("e", _found(F.col("line"), rf"{end}: *{_NUMBER}")).filter("s IS NOT NULL OR e IS NOT NULL")
    # A start and an end on one line belong together; else an end belongs to the last start before it.
    marks = marks.withColumn("__start", F.last("s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__next", F.lead(F.when(F.col("s").isNull() & F.col("e").isNotNull(), True).otherwise(False)).over(w))
    closed = marks.filter("e IS NOT NULL AND __start IS NOT NULL").select(*by, F.greatest(F.lit(0.0), "__start").alias("start"), F.col("e").alias("end"))
    last = marks.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n")))).filter("__k = 1 AND s IS NOT NULL AND e IS NULL")
    open_end = last.join(lengths, list(by)).select(*by, F.greatest(F.lit(0.0), "s").alias("start"), F.col(length).cast("double").alias("end"))
    return closed.unionByName(open_end).filter("end > start")


def black_spans(text: Column) -> Column:
    """Array of (start, end, duration) of black frames in a log."""
    parts = [F.regexp_extract_all(text, F.lit(rf"{name}:{_NUMBER}"), F.lit(1)) for name in ("black_start", "black_end", "black_duration")]
    row = lambda r: F.struct(*(r[str(k)].try_cast("double").alias(name) for k, name in enumerate(("start", "end", "duration"))))
    return F.transform(F.arrays_zip(*(p.alias(str(k)) for k, p in enumerate(parts))), row)


def scene_times(text: Column) -> Column:
    """The distinct pts_time values of a log, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"pts_time:{_NUMBER}"), F.lit(1)), lambda x: x.cast("double"))))


def scene_scores(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, time, score): scores paired with the last time before them, the largest of each time."""
    w = Window.partitionBy(*by).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("time", F.last(_found(F.col("line"), rf"pts_time:{_NUMBER}"), ignorenulls=True).over(w)).withColumn("score", _found(F.col("line"), rf"scene_score={_NUMBER}"))
    return rows.filter("score IS NOT NULL AND time IS NOT NULL").groupBy(*by, "time").agg(F.max("score").alias("score"))


def frame_values(lines: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(by, time, names...): values `<name>=x` of each frame of a log; frames without all of them are dropped."""
    w = Window.partitionBy(*by).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("time", F.last(_found(F.col("line"), rf"pts_time:{_NUMBER}"), ignorenulls=True).over(w))
    return rows.filter("time IS NOT NULL").groupBy(*by, "time").agg(*(F.max(_found(F.col("line"), rf"\b{n}={_NUMBER}")).alias(n) for n in names)).dropna(subset=list(names))


def loudness(text: Column) -> Column:
    """Struct (integrated, range, peak) of a loudness summary; null where it has none."""
    last = lambda pattern: F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1)).try_cast("double")
    return F.struct(last(rf"I: +{_NUMBER} LUFS").alias("integrated"), last(rf"LRA: +{_NUMBER} LU\b").alias("range"), last(rf"Peak: +{_NUMBER} dBFS").alias("peak"))


def noise_threshold(text: Column, fallback: float) -> Column:
    """input_thresh of the last JSON in a log, kept between -60 and -25."""
    value = F.try_element_at(F.regexp_extract_all(text, F.lit(rf'"input_thresh" *: *"{_NUMBER}"'), F.lit(1)), F.lit(-1)).try_cast("double")
    return F.least(F.lit(-25.0), F.greatest(F.lit(-60.0), F.coalesce(value, F.lit(fallback))))


def rttm(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, start, end, speaker) of SPEAKER lines; lines without proper numbers or of no length are dropped."""
    parts = F.split(F.trim("line"), r"\s+")
    rows = lines.select(*by, parts.alias("p")).filter((F.try_element_at("p", F.lit(1)) == "SPEAKER") & (F.size("p") >= 8))
    start, length = F.col("p")[3].try_cast("double"), F.col("p")[4].try_cast("double")
    return rows.select(*by, start.alias("start"), (start + length).alias("end"), F.col("p")[7].alias("speaker")).filter("start IS NOT NULL AND end > start")


def srt_cues(files: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """(by, number, start, end, text) in milliseconds from whole SRT files; blocks without a time line are dropped."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "^\\ufeff", ""), "\r\n?", "\n")
    block = files.select(*by, F.posexplode(F.split(clean, r"\n[ \t]*\n+")).alias("k", "block"))
    time = r"(\d+):(\d{2}):(\d{2})[,.](\d{1,3})"
    ms = lambda g: sum((F.regexp_extract("block", time + r"\s*-->\s*" + time, g + i).try_cast("long") * unit for i, unit in enumerate((3_600_000, 60_000, 1000))), F.lit(0)) + F.rpad(F.regexp_extract("block", time + r"\s*-->\s*" + time, g + 3), 3, "0").try_cast("long")
    body = F.trim(F.regexp_replace(F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)", 1), r"\s+$", ""))
    number = F.regexp_extract("block", r"^\s*(\d+)\s*\n", 1).try_cast("int")
    rows = block.filter(F.col("block").rlike(time + r"\s*-->\s*" + time))
    return rows.select(*by, F.coalesce(number, F.col("k") + 1).alias("number"), ms(1).alias("start"), ms(5).alias("end"), body.alias("text"))


def transcript_units(transcripts: DataFrame, by: Sequence[str], segments: str = "segments") -> DataFrame:
    """(by, segment, k, start, end, text, speaker): one row a word of nested segments (id, start, end, text, speaker, words), the segment itself where it has no words. Words without times get those of the segment; spacing and sound events are dropped."""
    flat = transcripts.select(*by, F.inline(segments))
    own = F.array(F.struct(F.col("text").alias("word"), "start", "end", F.col("speaker").alias("speaker"), F.lit("word").alias("type")))
    words = F.when(F.size(F.coalesce("words", F.array().cast(flat.schema["words"].dataType))) > 0, F.transform("words", lambda w: F.struct(w["word"].alias("word"), w["start"].alias("start"), w["end"].alias("end"), w["speaker"].alias("speaker"), w["type"].alias("type")))).otherwise(own)
    rows = flat.select(*by, F.col("id").alias("segment"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("speaker").alias("sp"), F.posexplode(words).alias("k", "w"))
    kept = rows.filter(~F.coalesce(F.col("w.type"), F.lit("word")).isin("spacing", "audio_event"))
    return kept.select(*by, "segment", "k", F.coalesce("w.start", "s").alias("start"), F.coalesce("w.end", "e").alias("end"), F.col("w.word").alias("text"), F.coalesce("w.speaker", "sp").alias("speaker"))


def file_listing(spark, path: str) -> DataFrame:
    """(path, length, modified) of all files below a folder that Spark can list; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
