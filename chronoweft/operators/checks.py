"""Rules on single records as columns: what may be shown, asked for, published; identities, samples and choices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What must not be seen in a picture, by label.
INTERNAL_TEXT: dict[str, str] = {
    "speed multiplier": r"\b\d+(?:\.\d+)?\s*[xX]\b",
    "whisper engine name": r"\b(?:mlx|faster|openai)[-_]?whisper\b",
    "whisper model name": r"\bwhisper[-_]?(?:large|medium|small|base|tiny|turbo)",
    "ffmpeg filter name": r"\b(?:atempo|dynaudnorm|loudnorm|acompressor|drawtext|ass=)\b",
    "debug marker": r"\b(?:DEBUG|TODO|FIXME|XXX|HACK)\b",
    "tempfile marker": r"(?:_temp|_tmp|\.tmp)\b",
}
# Words of a punchline.
PUNCHLINE_WORDS = ("哈哈", "笑", "对吧", "就这", "完了", "没了", "真的", "太", "绝了", "离谱", "卧槽", "我去", "可以", "牛")
# Comfortable pace of speech, characters or words a second.
CHARS_A_SECOND, WORDS_A_SECOND = 5.2, 2.7
# What a project still needs, by what is missing, in order; then what blocks it.
NEEDS_BY_MISSING = {"transcript": "needs_transcription", "clean_script": "needs_clean_script", "storyboard_plan": "needs_storyboard_plan", "render_config": "needs_render_config", "master_video": "needs_render", "render_qa": "needs_render_qa", "caption": "needs_caption", "publish_package": "needs_publish_package"}
NEEDS_BY_BLOCKED = {"generation_task_log": "waiting_on_generation_tasks", "provider_decision": "needs_generation_approval", "video_prompt_pack": "needs_generation_approval", "storyboard_assets": "needs_asset_resolution", "render_qa": "needs_qa_fix", "publish_package": "needs_publish_package_fix"}


def internal_text(text: Column) -> Column:
    """The label of the first pattern of INTERNAL_TEXT in a text; null where none is."""
    out = F.lit(None).cast("string")
    for label, pattern in reversed(INTERNAL_TEXT.items()):
        out = F.when(text.rlike(f"(?i){pattern}"), label).otherwise(out)
    return out


def label_allowed(label: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Whether a label is among the included ones, if there are any, and not among the excluded; in any case."""
    low = F.lower(label)
    wanted = low.isin(*(x.lower() for x in include)) if include else F.lit(True)
    return wanted & ~(low.isin(*(x.lower() for x in exclude)) if exclude else F.lit(False))


def punchline(text: Column, before: Column) -> Column:
    """Whether a text is a punchline: short after a long one, with a mark, or with one of the words."""
    short = (F.coalesce(before, F.lit("")) != "") & (F.length(text) < F.length(before) * 0.4)
    return F.coalesce(short, F.lit(False)) | text.rlike("[！!？?]") | text.rlike("|".join(PUNCHLINE_WORDS))


@dataclass(frozen=True)
class Capabilities:
    """What a provider offers; `*` stands for anything. durations: fixed values, or a range if least and most are given."""

    modes: Sequence[str]
    aspects: Sequence[str]
    resolutions: Sequence[str]
    least_seconds: float | None = None
    most_seconds: float | None = None
    fixed_seconds: Sequence[float] = field(default_factory=tuple)
    most_images: int | None = None


def support_issues(has: Capabilities, mode: Column, aspect: Column, seconds: Column, resolution: Column, images: Column) -> Column:
    """An array with what a provider can't do of a request."""
    offered = lambda c, values: F.lit("*" in values) | F.coalesce(c.isin(*values), F.lit(False))
    told = F.regexp_replace(seconds.cast("string"), r"\.0$", "")
    if has.least_seconds is not None:
        fits = seconds.between(has.least_seconds, has.most_seconds)
    else:
        fits = F.exists(F.array(*(F.lit(float(v)) for v in has.fixed_seconds)), lambda v: F.abs(v - seconds) <= 1e-6)
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(mode.isin(*has.modes), F.lit(False)), F.concat(F.lit("unsupported_mode:"), mode)),
            F.when(~offered(aspect, has.aspects), F.concat(F.lit("unsupported_aspect:"), aspect)),
            F.when(~fits, F.concat(F.lit("unsupported_duration:"), told)),
            F.when(F.coalesce(resolution, F.lit("")) == "", "resolution_not_selected").when(~offered(resolution, has.resolutions), F.concat(F.lit("unsupported_resolution:"), resolution)),
            F.when(images > has.most_images, F.concat(F.lit("image_reference_limit_exceeded:"), images.cast("string"), F.lit(f">{has.most_images}"))) if has.most_images is not None else F.lit(None).cast("string"),
        )
    )


def timeline_bound(start: Column, end: Column, length: Column, tolerance: float = 250) -> Column:
    """What is wrong with a cue against the timeline's length: it starts after it, or only ends after it; null if nothing, or if the length isn't known."""
    return F.when(start > length + tolerance, "cue_after_timeline").when(end > length + tolerance, "cue_extends_past_timeline")


def draft_problems(hook: Column, others: Mapping[str, Column], value: Column, seconds: Column, most_seconds: float) -> Column:
    """An array with what is wrong with a drafted script: missing parts, a hook of over 18 characters, no or too many points, too long to speak."""
    parts = {"hook": hook, **others, "value": value}
    order = ("hook", "pain", "turn", "value", "cta")
    missing = [F.when(parts[p].isNull(), F.lit(f"missing required field: {p}")) for p in order]
    return F.array_compact(
        F.array(
            *missing,
            F.when(F.length(hook) > 18, F.concat(F.lit("hook too long ("), F.length(hook).cast("string"), F.lit(" > 18 chars)"))),
            F.when(~F.size(value).between(1, 5) & value.isNotNull(), F.concat(F.lit("value should have 1-5 bullets, got "), F.size(value).cast("string"))),
            F.when(seconds > most_seconds, F.concat(F.lit("estimated_speech_seconds "), seconds.cast("string"), F.lit(f" exceeds max_duration {most_seconds}"))),
        )
    )


def safe_zone(width: Column, height: Column, left: Column, top: Column, right: Column, bottom: Column, overrides: Mapping[str, Column] | None = None) -> Column:
    """The box (left, top, right, bottom, width, height) inside margins given as shares of the canvas, or in pixels by an override that isn't null; null where nothing is left."""
    given = dict(overrides or {})
    margin = lambda name, share, size: F.coalesce(given[name], share * size) if name in given else share * size
    l, t, r, b = margin("left", left, width), margin("top", top, height), margin("right", right, width), margin("bottom", bottom, height)
    at = lambda c: F.round(c, 3)
    box = F.struct(at(l).alias("left"), at(t).alias("top"), at(width - r).alias("right"), at(height - b).alias("bottom"), at(width - l - r).alias("width"), at(height - t - b).alias("height"))
    return F.when((l + r < width) & (t + b < height), box)


def shared_coverage(reference: Column, source: Column, offset: Column) -> Column:
    """Where a source that begins at offset of the reference lies in both clocks (ref_start, ref_end, src_start, src_end); null where they don't meet."""
    start, end = F.greatest(F.lit(0.0), offset), F.least(reference, offset + source)
    at = lambda c: F.round(c, 4)
    return F.when(end > start, F.struct(at(start).alias("ref_start"), at(end).alias("ref_end"), at(start - offset).alias("src_start"), at(end - offset).alias("src_end")))


def sample_points(start: Column, end: Column, shares: Sequence[float] = (0.1, 0.5, 0.9)) -> Column:
    """Places at the shares of a range, an array of (fraction, time)."""
    return F.array(*(F.struct(F.lit(s).alias("fraction"), F.round(start + (end - start) * s, 6).alias("time")) for s in shares))


def preview_times(length: Column, shares: Sequence[float] = (0.15, 0.5, 0.85)) -> Column:
    """Places at the shares of a length, but not within 0.04 of its end; null where two of them coincide."""
    limit = F.greatest(F.lit(0.0), length - F.least(F.lit(0.04), length / 2))
    times = F.array(*(F.round(F.least(length * s, limit), 3) for s in shares))
    return F.when((length > 0) & (F.size(F.array_distinct(times)) == len(shares)), times)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def candidate_id(target: Column, source: Column, start: Column, end: Column) -> Column:
    """A stable name of a passage: target, source with a part of its digest, times in ms."""
    return F.concat(target, F.lit(":"), slug(source), F.lit("-"), F.substring(F.sha1(source), 1, 6), F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def proposal_id(category: Column, replacement: Column, segment: Column, source: Column, span_end: Column, span_start: Column) -> Column:
    """A stable name of a proposed change: a part of the digest of its fields as canonical JSON."""
    body = F.struct(category.alias("category"), replacement.alias("replacement"), segment.alias("segment_id"), source.alias("source"), span_end.alias("span_end"), span_start.alias("span_start"))
    return F.concat(F.lit("patch-"), F.substring(F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256), 1, 12))


def credit_line(provider: Column, creator: Column, url: Column, licence: Column, attribution: Column) -> Column:
    """The attribution as given, else who made an asset, where it is from and under which licence."""
    filled = lambda c: F.nullif(c, F.lit(""))
    label = F.initcap(F.replace(provider, F.lit("_"), F.lit(" ")))
    made = F.concat_ws(" ", F.coalesce(F.concat(F.lit("Asset by "), filled(creator)), F.lit("Asset")), F.when(filled(provider).isNotNull(), F.concat(F.lit("on "), label)), filled(url), F.concat(F.lit("("), filled(licence), F.lit(")")))
    return F.coalesce(filled(attribution), made)


def speech_speed(text: Column, seconds: Column, language: Column) -> Column:
    """How much faster than comfortable a text must be spoken to fit; by characters for Chinese, by words otherwise."""
    chinese = (language == "zh") | text.rlike("[\\u4e00-\\u9fff]")
    words = F.regexp_count(text, F.lit(r"\S+"))
    return F.when((F.coalesce(text, F.lit("")) == "") | (seconds <= 0), 0.0).when(chinese, F.length(F.replace(text, F.lit("\n"), F.lit(""))) / seconds / CHARS_A_SECOND).otherwise(words / seconds / WORDS_A_SECOND)


def segment_budget(rows: DataFrame, by: Sequence[str], limit: float) -> DataFrame:
    """(by, total, status) of ranges (by, start, end): fail above the limit, warn below it."""
    total = F.sum(F.col("end") - F.col("start"))
    return rows.groupBy(*by).agg(total.alias("total")).withColumn("status", F.when(F.col("total") > limit, "fail").otherwise("warn"))


def sampled_parts(parts: DataFrame, by: Sequence[str], order: Sequence[str], limit: int, kind: str = "kind") -> DataFrame:
    """Evenly spread parts of each key, `limit` of them, and the first of each kind besides; all where there are no more than that."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = parts.withColumn("__k", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*by))).withColumn("__first", F.row_number().over(Window.partitionBy(*by, kind).orderBy(*order)) == 1)
    if limit == 1:
        keep = F.col("__k") == F.floor(F.col("__n") / 2)
    else:
        even = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda p: F.bround(p * (F.col("__n") - 1) / (limit - 1)).cast("int"))
        keep = F.array_contains(even, F.col("__k")) | F.col("__first")
    return rows.filter((F.col("__n") <= limit) | keep).drop("__k", "__n", "__first")


def retry_choice(before: Column, after: Column) -> Column:
    """Which of two takes of a sentence goes: the first one, if the second is clearly longer, else the second."""
    longer = F.length(after) >= F.greatest(F.lit(1), F.floor(F.length(before) * 1.15))
    return F.when(longer, "repeated_before_retry").otherwise("repeated_duplicate")


def phase(status: Column, stage: Column, missing: Column, blocked: Column) -> Column:
    """The first thing that a project needs: what is missing, then what blocks it, then a review."""
    out = F.when(F.size(blocked) > 0, F.concat(F.lit("blocked_by_"), F.array_min(blocked))).when(status == "warn", "needs_warning_review").otherwise("in_progress")
    for column, needs in ((blocked, NEEDS_BY_BLOCKED), (missing, NEEDS_BY_MISSING)):
        for name, told in reversed(needs.items()):
            out = F.when(F.array_contains(column, name), told).otherwise(out)
    return F.when(status == "ready", F.when(stage != "", F.concat(stage, F.lit("_ready"))).otherwise("ready")).otherwise(out)


def best_named(text: Column, moods: Mapping[str, Sequence[str]], default: str) -> Column:
    """The name whose words occur most in a text; of several the first by name, the default if no word occurs."""
    low = F.lower(text)
    hits = lambda words: sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    scored = F.array(*(F.struct((-hits(words)).alias("less"), F.lit(name).alias("name")) for name, words in moods.items()))
    best = F.array_min(scored)
    return F.when(best["less"] < 0, best["name"]).otherwise(default)


def audio_score(kind: Column, tokens: Column, wanted: str, words: Sequence[str]) -> Column:
    """How well an audio asset fits: by its kind, its tokens among the words, and names of that kind."""
    named = {"music": ("bgm", "music", "bed"), "sfx": ("sfx", "fx")}.get(wanted, ())
    score = F.when(kind == wanted, 6).when(kind == "audio", 1).otherwise(0) + 4 * F.size(F.array_intersect(tokens, F.array(*(F.lit(w.lower()) for w in words))))
    return score + F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, named))), 2).otherwise(0) if named else score


def best_audio(assets: DataFrame, by: Sequence[str], wanted: str, words: Sequence[str]) -> DataFrame:
    """(by, path, score): of assets (by, path, kind, tokens) the best that fits at all; of several the first by path."""
    scored = assets.withColumn("score", audio_score(F.col("kind"), F.col("tokens"), wanted, words)).filter("score > 0")
    return scored.groupBy(*by).agg(F.min(F.struct((-F.col("score")).alias("less"), "path")).alias("r")).select(*by, F.col("r.path").alias("path"), (-F.col("r.less")).alias("score"))


def story_section(index: Column, total: Column, text: Column, calls: Sequence[str]) -> Column:
    """The part of a story that a group of sentences belongs to, by its place from 0 and by what it says."""
    low, ratio = F.lower(text), index / F.greatest(F.lit(1), total - 1)
    called = F.lit(False)
    for c in calls:
        called = called | F.contains(text, F.lit(c))
    turns = F.contains(low, F.lit("but")) | F.contains(low, F.lit("however")) | F.contains(text, F.lit("但是")) | F.contains(text, F.lit("反而"))
    return F.when(called, "cta").when(index == 0, "hook").when(index == total - 1, "cta").when(ratio <= 0.25, "pain").when((ratio <= 0.45) | turns, "turn").otherwise("value")


def anchor(words: Column, needle: Column, text: Column, start: Column, end: Column) -> Column:
    """When a phrase is spoken: at the first of the words (start, end, text) that holds it or is in it, else by its place in the text."""
    low = F.lower(F.trim(needle))
    fits = F.filter(words, lambda w: (w["text"] != "") & (F.contains(F.lower(w["text"]), low) | F.contains(low, F.lower(w["text"]))))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.instr(F.lower(text), low) - 1) / F.greatest(F.length(text), F.lit(1))))
    place = F.when(F.instr(F.lower(text), low) > 0, start + (end - start) * share)
    return F.when(low == "", None).otherwise(F.coalesce(F.try_element_at(fits, F.lit(1))["start"].cast("double"), place))
