"""Filter expressions and commands of media tools as string columns; nothing is run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft.functions.text import fixed
from chronoweft.sources.sinks import joined


def trim_filters(segments: DataFrame, by: Sequence[str]) -> DataFrame:
    """Kept ranges (by, number, start, end in ms) as a filter graph that cuts and joins picture and sound."""
    s, e, n = F.col("start") / 1000, F.col("end") / 1000, F.col("number")
    part = F.concat(F.format_string("[0:v]trim=%.3f:%.3f,setpts=PTS-STARTPTS[v%d];", s, e, n), F.format_string("[0:a]atrim=%.3f:%.3f,asetpts=PTS-STARTPTS[a%d]", s, e, n))
    graph = joined(segments, by, ["number"], part, ";").withColumnRenamed("text", "parts")
    labels = joined(segments, by, ["number"], F.format_string("[v%d][a%d]", n, n), "").withColumnRenamed("text", "labels")
    count = segments.groupBy(*by).agg(F.count("*").alias("n"))
    return graph.join(labels, list(by)).join(count, list(by)).select(*by, F.format_string("%s;%sconcat=n=%d:v=1:a=1[v][a]", "parts", "labels", "n").alias("text"))


def box_filters(boxes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Boxes (by, start, end in ms, x1...y2 in pixels) as filters that cover them while they last."""
    line = F.format_string("drawbox=x=%d:y=%d:w=%d:h=%d:t=fill:enable='between(t,%.3f,%.3f)'", F.col("x1").cast("int"), F.col("y1").cast("int"), (F.col("x2") - F.col("x1")).cast("int"), (F.col("y2") - F.col("y1")).cast("int"), F.col("start") / 1000, F.col("end") / 1000)
    return joined(boxes, by, ["start", "end", "x1", "y1"], line, ",")


def grade_filter(brightness: Column, contrast: Column, saturation: Column) -> Column:
    """A colour filter with values kept in range."""
    kept = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    return F.format_string("eq=brightness=%.3f:contrast=%.3f:saturation=%.3f", kept(brightness, -0.3, 0.3), kept(contrast, 0.5, 1.5), kept(saturation, 0.0, 2.0))


def command(words: Sequence[Column]) -> Column:
    """A command line; words with anything but plain characters are quoted."""
    quoted = lambda w: F.when(w.rlike("^[A-Za-z0-9_./:=,@%+-]+$"), w).otherwise(F.concat(F.lit("'"), F.replace(w, F.lit("'"), F.lit("'\\''")), F.lit("'")))
    return F.concat_ws(" ", *[quoted(w) for w in words])


# Filters of speech and of music under it, and colours of a chapter bar.
SPEECH_DYNAMICS = ("dynaudnorm=f=250:g=15", "acompressor=threshold=-18dB:ratio=3:attack=20:release=200", "loudnorm=I=-16:TP=-1.5:LRA=11")
MUSIC_FORMAT = "aformat=sample_fmts=fltp:sample_rates=48000:channel_layouts=stereo"


def plain_number(c: Column) -> Column:
    """A number without needless zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c.cast("double")), "0+$", ""), r"\.$", "")


def speech_filters(speed: Column, loudness: Column, cover_ms: Column, first: Sequence[str] = ()) -> Column:
    """Filters of a voice in order: the given first ones, its speed in steps of at most 2, its loudness, then silence for a cover so that it isn't made louder."""
    doubled = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.struct(speed.cast("double").alias("left"), F.lit(0).alias("n")), lambda acc, _: F.when(acc["left"] > 2, F.struct((acc["left"] / 2).alias("left"), (acc["n"] + 1).alias("n"))).otherwise(acc))
    tempo = F.when(speed != 1, F.concat(F.repeat(F.lit("atempo=2.0,"), doubled["n"]), F.format_string("atempo=%.4f", doubled["left"])))
    return F.concat_ws(",", *map(F.lit, first), tempo, F.when(loudness, ",".join(SPEECH_DYNAMICS)), F.when(cover_ms > 0, F.concat(F.lit("adelay="), cover_ms.cast("int").cast("string"), F.lit(":all=1"))))


def music_filters(index: Column, seconds: Column, volume: Column, fade: Column, ducked: Column, voice: str = "[voice]", threshold: float = 0.03, ratio: float = 8, attack_ms: float = 20, release_ms: float = 300) -> Column:
    """Music laid under a voice, looped, cut, faded, and if asked for pressed down while someone speaks; lines of a filter graph."""
    fading = F.when(fade > 0, F.format_string(",afade=t=out:st=%.4f:d=%.4f", F.greatest(F.lit(0.0), seconds - fade), fade)).otherwise("")
    music = F.concat(F.format_string("[%d:a]aloop=loop=-1:size=2147483647,atrim=duration=%.4f,asetpts=PTS-STARTPTS,volume=%.2f", index, seconds, volume), fading)
    plain = F.concat(music, F.lit(f"[bgm_a];{voice}[bgm_a]amix=inputs=2:duration=first:dropout_transition=0[final_a]"))
    press = f"sidechaincompress=threshold={threshold:g}:ratio={ratio:g}:attack={attack_ms:g}:release={release_ms:g}:knee=2.82843:detection=rms:level_sc=1"
    pressed = f",{MUSIC_FORMAT}[bgm_a];{voice}{MUSIC_FORMAT},asplit=2[voice_mix][voice_sc];[bgm_a][voice_sc]{press}[bgm_ducked];[voice_mix][bgm_ducked]amix=inputs=2:duration=first:dropout_transition=0:normalize=0,alimiter=limit=0.95:level=false[final_a]"
    return F.when(ducked, F.concat(music, F.lit(pressed))).otherwise(plain)


def escaped_label(text: Column) -> Column:
    """A text for a drawing filter: its special characters escaped."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in (":", "'", "%"):
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return out


def proxy_filter(most_height: Column, fps: Column, label: Column, timecode: Column) -> Column:
    """A small picture for review, with a label and a running clock if asked for."""
    named = F.trim(label) != ""
    box = "fontcolor=white:fontsize=h/30:box=1:boxcolor=black@0.68:boxborderw=10:x=20:y="
    size = F.concat(F.lit("scale=-2:'min(ih,"), most_height.cast("string"), F.lit(")':flags=lanczos"))
    told = F.when(named, F.concat(F.lit("drawtext=text='"), escaped_label(F.trim(label)), F.lit(f"':{box}20")))
    clock = F.when(timecode, F.concat(F.lit("drawtext=text='%{pts\\:hms}':" + box), F.when(named, "20+h/30+18").otherwise("20")))
    return F.concat_ws(",", size, F.concat(F.lit("fps="), plain_number(fps)), told, clock)


def stabilising_filter(smoothing: Column, zoom: Column, crop: Column, sharpen: Column, transforms: Column) -> Column:
    """A filter that steadies a picture by measured transforms, sharpened again if asked for."""
    steady = F.concat(F.lit("vidstabtransform=input="), transforms, F.lit(":smoothing="), smoothing.cast("string"), F.lit(":optzoom="), zoom.cast("string"), F.lit(":crop="), crop)
    return F.when(sharpen > 0, F.concat(steady, F.format_string(",unsharp=5:5:%.3f:3:3:0", sharpen))).otherwise(steady)


def chapter_bar(chapters: DataFrame, lengths: DataFrame, by: Sequence[str], width: int, height: int, colours: Sequence[str]) -> DataFrame:
    """Chapters (by, number, start, end in ms) of a picture of `duration` (by lengths) as a bar with a part for each, lines between them and a head that moves."""
    short, portrait = min(width, height), height > width
    bar = max(6, int(short * 0.015))
    y = int(height * 0.03) if portrait else height - bar
    head = max(2, bar // 3)
    rows = chapters.join(lengths, list(by))
    share = lambda c: c / F.col("duration")
    colour = F.element_at(F.array(*map(F.lit, colours)), ((F.col("number") - 1) % len(colours) + 1).cast("int"))
    begin, length = fixed(share(F.col("start")), 6), fixed(share(F.col("end") - F.col("start")), 6)
    part = F.concat(F.lit("drawbox=x=iw*"), begin, F.lit(f":y={y}:w=iw*"), length, F.lit(f":h={bar}:color="), colour, F.lit("@0.85:t=fill"))
    line = F.when(F.col("number") > 1, F.concat(F.lit("drawbox=x=iw*"), begin, F.lit(f"-1:y={y}:w=2:h={bar}:color=white@0.9:t=fill")))
    parts = joined(rows, by, ["number"], part, ",").withColumnRenamed("text", "parts")
    lines = joined(rows.filter("number > 1"), by, ["number"], line, ",").withColumnRenamed("text", "lines")
    seconds = F.format_string("%.4f", F.col("duration") / 1000)
    ends = F.concat(F.lit("drawbox=x=0:y=%d:w='iw*t/" % y), seconds, F.lit(f"':h={bar}:color=white@0.35:t=fill,drawbox=x='iw*t/"), seconds, F.lit(f"-{head // 2}':y={y - 1}:w={head}:h={bar + 2}:color=white@0.95:t=fill"))
    all_parts = parts.join(lines, list(by), "left").join(lengths, list(by))
    return all_parts.select(*by, F.concat_ws(",", F.lit(f"drawbox=x=0:y={y}:w=iw:h={bar}:color=black@0.5:t=fill"), "parts", "lines", ends).alias("text"))


def angle_grid(angles: DataFrame, by: Sequence[str], width: int = 480, height: int = 270) -> DataFrame:
    """Angles (by, number from 0) of a shoot side by side, two in a row, as a filter graph."""
    n = F.col("number").cast("int")
    cell = F.format_string(f"[%d:v:0]scale={width}:{height}:force_original_aspect_ratio=decrease,pad={width}:{height}:(ow-iw)/2:(oh-ih)/2:black,setsar=1,setpts=PTS-STARTPTS[v%d]", n, n)
    place = F.format_string("%d_%d", (n % 2) * width, F.floor(n / 2) * height)
    cells = joined(angles, by, ["number"], cell, ";").withColumnRenamed("text", "cells")
    labels = joined(angles, by, ["number"], F.format_string("[v%d]", n), "").withColumnRenamed("text", "labels")
    places = joined(angles, by, ["number"], place, "|").withColumnRenamed("text", "places")
    counted = angles.groupBy(*by).agg(F.count("*").alias("n"))
    both = cells.join(labels, list(by)).join(places, list(by)).join(counted, list(by))
    return both.select(*by, F.format_string("%s;%sxstack=inputs=%d:layout=%s:fill=black[vout]", "cells", "labels", "n", "places").alias("text"))
