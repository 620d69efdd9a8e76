"""Edits and what belongs to them: parts kept and dropped, stories, detections on frames, rhythm, covers, transitions, delivery settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.operators import greedy, joins

# Kinds and lengths of audio transitions, and of a delivery's bit rate.
TRANSITION_KINDS = ("j_cut", "l_cut")
LEAST_TRANSITION, MOST_TRANSITION = 0.05, 2.0
SAFETY, LEAST_VIDEO_BPS = 0.94, 150_000
#: Boundaries that a task of timeline_rhythm gets.
RHYTHM_ROWS = 500_000


def matched_story(events: DataFrame, stories: DataFrame, keys: Sequence[str], event_key: str = "id", story_key: str = "story_id") -> DataFrame:
    """events with `story`: the one story that any of their keys names; null where none or several are named."""
    named = events.select(event_key, F.explode(F.array_distinct(F.array(*(F.trim(F.col(k).cast("string")) for k in keys)))).alias("__key"))
    hits = named.join(stories.select(F.col(story_key).cast("string").alias("__key")).distinct(), "__key").groupBy(event_key).agg(F.count("*").alias("__n"), F.min("__key").alias("__story"))
    return events.join(hits, event_key, "left").withColumn("story", F.when(F.col("__n") == 1, F.col("__story"))).drop("__n", "__story")


def kept_and_dropped(kept: DataFrame, lengths: DataFrame, by: Sequence[str], speed: float = 1.0, offset: float = 0) -> DataFrame:
    """(by, kind, start, end, program_start, program_end): kept ranges (by, start, end; they don't overlap) of a source and what is dropped between, before and after.

    Kept parts follow each other in the program at a speed, from an offset on.
    """
    w = Window.partitionBy(*by).orderBy("start", "end")
    length = (F.col("end") - F.col("start")) / speed
    before = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + offset
    rows = kept.withColumn("__from", F.coalesce(F.lag("end").over(w), F.lit(0))).withColumn("program_start", before)
    own = rows.select(*by, F.lit("kept").alias("kind"), "start", "end", "program_start", (F.col("program_start") + length).alias("program_end"))
    nothing = F.lit(None).cast("double")
    gaps = rows.filter("start > __from").select(*by, F.lit("dropped").alias("kind"), F.col("__from").alias("start"), F.col("start").alias("end"), nothing.alias("program_start"), nothing.alias("program_end"))
    last = lengths.join(kept.groupBy(*by).agg(F.max("end").alias("__last")), list(by), "left").withColumn("start", F.coalesce("__last", F.lit(0)))
    tail = last.filter("duration > start").select(*by, F.lit("dropped").alias("kind"), "start", F.col("duration").alias("end"), nothing.alias("program_start"), nothing.alias("program_end"))
    return own.unionByName(gaps).unionByName(tail)


def overlapping_keeps(kept: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, start, end, problem) of kept ranges that have no length, begin before 0 or before an earlier one ends."""
    w = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    problem = F.when((F.col("start") < 0) | (F.col("end") <= F.col("start")), "bad_range").when(F.col("start") < F.max("end").over(w), "overlaps")
    return kept.withColumn("problem", problem).filter("problem IS NOT NULL").select(*by, "start", "end", "problem")


def on_frames(detections: DataFrame, frames: DataFrame, by: Sequence[str]) -> DataFrame:
    """detections (by, id, frame_id, time, ...) with the frame that they name, else the one nearest in time of frames (by, frame_id, time); those that name an unknown frame are left out."""
    near = joins.nearest(detections.withColumnRenamed("time", "at"), frames.select(*by, F.col("time").alias("at")), by, "at", "at", None, "__t")
    first = frames.groupBy(*by, F.col("time").alias("__t")).agg(F.min("frame_id").alias("__near"))
    told = near.join(first, [*by, "__t"], "left").withColumn("frame_id", F.coalesce(F.nullif("frame_id", F.lit("")), "__near")).drop("__t", "__near").withColumnRenamed("at", "time")
    return told.join(frames.select(*by, "frame_id"), [*by, "frame_id"], "left_semi")


def scene_tags(detections: DataFrame, tracks: DataFrame, scenes: DataFrame, by: Sequence[str], category: str = "category") -> DataFrame:
    """(by, tag, evidence): categories of detections with their numbers, and whether a track is large or moves much; no_detected_objects for scenes (by) with neither."""
    counted = detections.groupBy(*by, F.col(category).alias("tag")).agg(F.count("*").alias("evidence"))
    seen = tracks.groupBy(*by).agg(F.bool_or(F.col("area") >= 0.22).alias("large"), F.bool_or(F.col("moved") >= 0.12).alias("moves"))
    flags = [seen.filter(flag).select(*by, F.lit(tag).alias("tag"), F.lit(1).cast("long").alias("evidence")) for flag, tag in (("large", "dominant_subject"), ("moves", "moving_subject"))]
    told = counted.unionByName(flags[0]).unionByName(flags[1])
    return told.unionByName(scenes.select(*by).distinct().join(told.select(*by), list(by), "left_anti").select(*by, F.lit("no_detected_objects").alias("tag"), F.lit(0).cast("long").alias("evidence")))


def timeline_rhythm(boundaries: DataFrame, lengths: DataFrame, by: Sequence[str], rows_a_task: int = RHYTHM_ROWS) -> DataFrame:
    """(by, cuts, shots, cuts_per_minute, mean, median, p90, shortest, longest, variation, final_hold, final_share, opening, middle, closing and their shares of all cuts) of boundaries (by, at) of timelines of `duration`, in seconds.

    Boundaries and the one length of each timeline are dealt out together, some rows_a_task to a task whatever the input, and sorted once; all that follows reads that order.
    """
    known = [F.col(k).isNotNull() for k in by]
    cuts = boundaries.select(*by, F.col("at").cast("double").alias("at"), F.lit(None).cast(lengths.schema["duration"].dataType).alias("duration"), F.lit(True).alias("cut"))
    n = max(int(boundaries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-boundaries.count() // rows_a_task))
    for k in known:
        cuts = cuts.filter(k)
    marks = cuts.filter("at > 0").unionByName(lengths.select(*by, F.lit(0.0).alias("at"), "duration", F.lit(False).alias("cut"))).repartition(n, *by)
    order = Window.partitionBy(*by).orderBy("at")
    # A timeline's own row is at 0 and so before its cuts.
    marks = marks.withColumn("duration", F.max("duration").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(~F.col("cut") | (F.col("at") < F.col("duration")))
    marks = marks.withColumn("__at", F.round("at", 3)).withColumn("__last", F.lag(F.struct("cut", "__at")).over(order))
    marks = marks.filter(~F.coalesce(F.col("cut") & F.col("__last.cut") & (F.col("__last.__at") == F.col("__at")), F.lit(False)))
    shots = marks.withColumn("end", F.coalesce(F.lead("__at").over(order), "duration")).withColumn("d", F.when(F.col("end") > F.col("__at"), F.round(F.col("end") - F.col("__at"), 3)))
    third = F.least(F.lit(2), F.floor(F.col("__at") / F.col("duration") * 3))
    phases = ("opening", "middle", "closing")
    mean = F.sum(F.round(F.col("d") * 1000).cast("long")) / (F.count("d") * 1000)  # in whole milliseconds, as a sum of doubles depends on their order
    facts = shots.groupBy(*by, "duration").agg(
        F.count("d").alias("shots"), F.round(mean, 3).alias("mean"), F.round(F.median("d"), 3).alias("median"), F.round(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY d)"), 3).alias("p90"),
        F.min("d").alias("shortest"), F.max("d").alias("longest"), F.round(F.stddev_pop("d") / mean, 3).alias("variation"), F.max_by("d", F.when(F.col("d").isNotNull(), F.col("__at"))).alias("final_hold"),
        F.count_if("cut").alias("cuts"), *(F.count_if(F.col("cut") & (third == k)).alias(name) for k, name in enumerate(phases)),
    )
    both = facts.filter("shots > 0")
    for phase in phases:
        both = both.withColumn(f"{phase}_share", F.when(F.col("cuts") > 0, F.round(F.col(phase) / F.col("cuts"), 6)).otherwise(0.0))
    both = both.withColumn("final_share", F.round(F.col("final_hold") / F.col("duration"), 6))
    return both.withColumn("cuts_per_minute", F.round(F.col("cuts") * 60 / F.col("duration"), 6)).drop("duration")


def cover_terms(text: Column) -> Column:
    """Words of two ASCII letters or digits or more, and Chinese runs of two to four characters, longer ones in pairs; distinct, in order."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]{2,}"), F.lit(0)), F.lower)
    pairs = lambda run: F.when(F.length(run) <= 4, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))))
    return F.array_distinct(F.concat(words, F.flatten(F.transform(F.regexp_extract_all(text, F.lit("[\\u3400-\\u9fff]{2,}"), F.lit(0)), pairs))))


def cover_synergy(title: Column, cover: Column) -> Column:
    """warn where a cover says what the title says: one contains the other, or most of the cover's terms are the title's; not_checked without a title."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    a, b = plain(title), plain(cover)
    shared = F.size(F.array_intersect(cover_terms(title), cover_terms(cover))) / F.greatest(F.lit(1), F.size(cover_terms(cover)))
    same = (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    return F.when(F.coalesce(title, F.lit("")) == "", "not_checked").when(same | (shared >= 0.6), "warn").otherwise("pass")


def chapter_cards(titles: Column, duration: Column, boundaries: Column, most: int = 5) -> Column:
    """Cards (title, start) for the first titles: at the boundaries if there are enough, else evenly after the first 3 s."""
    n = F.least(F.size(titles), F.lit(most))
    step = (duration - 3.0) / (n + 1)
    snapped = F.size(boundaries) >= n
    return F.transform(F.slice(titles, F.lit(1), n), lambda t, i: F.struct(t.alias("title"), F.round(F.when(snapped, F.get(boundaries, i)).otherwise(3.0 + step * (i + 1)), 2).alias("start")))


def transitions(rows: DataFrame, by: Sequence[str], clips: str = "clips") -> DataFrame:
    """Transitions (by, after_clip, kind, duration, clips) with `number` by place, or with the `problem` that rules them out."""
    kind = F.replace(F.lower("kind"), F.lit("-"), F.lit("_"))
    first = F.row_number().over(Window.partitionBy(*by, "after_clip").orderBy("kind", "duration"))
    problem = (
        F.when(~kind.isin(*TRANSITION_KINDS), "unknown_kind")
        .when(~F.col("after_clip").between(1, F.col(clips) - 1), "no_such_boundary")
        .when(~F.col("duration").between(LEAST_TRANSITION, MOST_TRANSITION), "bad_duration")
        .when(first > 1, "duplicate_boundary")
    )
    checked = rows.withColumn("kind", kind).withColumn("problem", problem)
    good = F.col("problem").isNull()
    return checked.withColumn("number", F.when(good, F.row_number().over(Window.partitionBy(*by, good).orderBy("after_clip"))))


def transition_starts(segments: DataFrame, by: Sequence[str], markers: Sequence[str], least_gap: float, most: int) -> DataFrame:
    """(by, start) of segments (by, start, id, text) that say one of the markers, each at least least_gap after the one before and after 0, `most` of them."""
    said = F.lower("text").rlike("|".join(rf"\Q{m}\E" for m in markers))
    return greedy.cooldown(segments.filter(said & (F.col("start") >= least_gap)), by, "start", least_gap, ["id"], most).select(*by, "start")


def nearest_text(points: DataFrame, segments: DataFrame, by: Sequence[str]) -> DataFrame:
    """points (by, id, at) with the text of the segment (by, start, id, text) whose start is nearest; of equally near ones the earlier."""
    near = joins.nearest(points, segments.select(*by, F.col("start").alias("at")), by, "at", "at", None, "__s")
    first = segments.groupBy(*by, F.col("start").alias("__s")).agg(F.min_by("text", "id").alias("text"))
    return near.join(first, [*by, "__s"], "left").drop("__s")


def delivery_settings(size_mib: Column, seconds: Column, audio_bps: Column) -> Column:
    """(total, video, problem): bit rates that a file of a size allows, less a margin; too_small where too little is left for the picture."""
    total = F.floor(F.floor(size_mib * 1024 * 1024) * 8 * SAFETY / seconds)
    return F.struct(total.alias("total"), (total - audio_bps).alias("video"), F.when(total - audio_bps < LEAST_VIDEO_BPS, "too_small").alias("problem"))


def overlay_ranges(ranges: Column, start: Column, end: Column, duration: Column, position: Column) -> Column:
    """The ranges (start, end, position) of an overlay, or the whole of it where none are given; in order, those without length left out."""
    whole = F.array(F.struct(start.alias("start"), F.coalesce(end, start + duration).alias("end"), position.alias("position")))
    given = F.transform(ranges, lambda r: F.struct(F.coalesce(r["start"], F.lit(0.0)).alias("start"), F.coalesce(r["end"], r["start"], F.lit(0.0)).alias("end"), F.coalesce(F.nullif(r["position"], F.lit("")), position).alias("position")))
    return F.sort_array(F.filter(F.when(F.size(ranges) > 0, given).otherwise(whole), lambda r: r["end"] > r["start"]))


def focus_event(event: Mapping[str, Column], seconds: float = 1.2, zoom: float = 1.75) -> Column:
    """A point to look at (start, end, x, y, zoom): named fields `start`, `end`, `duration`, `x`, `y`, `source_width`, `source_height`, `zoom`, each may be null; pixels become shares, values are kept in range."""
    e = {n: event.get(n, F.lit(None)).cast("double") for n in ("start", "end", "duration", "x", "y", "source_width", "source_height", "zoom")}
    start = F.coalesce(e["start"], F.lit(0.0))
    end = F.coalesce(e["end"], start + F.coalesce(e["duration"], F.lit(seconds)))
    x, y = F.coalesce(e["x"], F.lit(0.5)), F.coalesce(e["y"], F.lit(0.5))
    pixels = ((x > 1) | (y > 1)) & (e["source_width"] > 0) & (e["source_height"] > 0)
    kept = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    share = lambda c, size: kept(F.when(pixels, c / size).otherwise(c), 0.0, 1.0)
    return F.struct(start.alias("start"), F.when(end <= start, start + seconds).otherwise(end).alias("end"), share(x, e["source_width"]).alias("x"), share(y, e["source_height"]).alias("y"), kept(F.coalesce(e["zoom"], F.lit(zoom)), 1.05, 4.0).alias("zoom"))


def adjusted(base: Mapping[str, float], overrides: Mapping[str, Column], bounds: Mapping[str, tuple[float, float]]) -> Column:
    """Adjustments as a struct: an override that isn't null, else the base, kept in its bounds; and `clamped`, the names of those that were out of them."""
    wanted = {n: F.coalesce(overrides[n].cast("double"), F.lit(float(base[n]))) if n in overrides else F.lit(float(base[n])) for n in bounds}
    kept = {n: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), wanted[n])) for n, (lo, hi) in bounds.items()}
    return F.struct(*(c.alias(n) for n, c in kept.items()), F.array_compact(F.array(*(F.when(kept[n] != wanted[n], F.lit(n)) for n in bounds))).alias("clamped"))


def scene_medians(samples: DataFrame, scenes: DataFrame, by: Sequence[str], values: Sequence[str], margin: float, width: int) -> DataFrame:
    """(by, id, n, near_edge, values): medians of samples (by, time, values) of each scene (by, id, start, end): those away from its edges by margin, or all where none is."""
    inside = joins.overlap_join(samples.withColumn("start", F.col("time")).withColumn("end", F.col("time") + 1), scenes.select(*by, "id", "start", "end"), by, width).filter((F.col("l_time") >= F.col("r_start")) & (F.col("l_time") < F.col("r_end")))
    edge = F.least(F.lit(margin), F.greatest(F.lit(0.0), (F.col("r_end") - F.col("r_start")) / 2 - 10))
    interior = F.col("l_time").between(F.col("r_start") + edge, F.col("r_end") - edge)
    marked = inside.withColumn("__in", interior).withColumn("__any", F.max(interior).over(Window.partitionBy(*by, "r_id")))
    return marked.filter("__in OR NOT __any").groupBy(*by, F.col("r_id").alias("id")).agg(F.count("*").alias("n"), F.bool_and(~F.col("__in")).alias("near_edge"), *(F.median(f"l_{v}").alias(v) for v in values))


def keyed_translations(items: DataFrame, keys: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """(key, text): the first filled text of each item under each of its keys; of items that share a key the last by `place`."""
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")), F.lit(""))
    rows = items.select("place", F.coalesce(*(clean(t) for t in texts)).alias("text"), F.explode(F.array(*(F.col(k).cast("string") for k in keys))).alias("key"))
    return rows.filter("text IS NOT NULL AND key IS NOT NULL AND key <> ''").groupBy("key").agg(F.max_by("text", "place").alias("text"))
