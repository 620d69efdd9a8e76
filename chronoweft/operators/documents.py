"""Nested documents: their strings by place, values by key, slots for paths, profiles laid under a configuration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of nesting that are walked; deeper values are an error, not lost.
MOST_LEVELS = 32


def walked(documents: DataFrame, by: Sequence[str], json: str = "json") -> DataFrame:
    """(by, location, key, value) of every string, number and boolean of JSON documents; location is `$` with `.key` and `[n]` from the top, value text.

    Each level is exploded in turn, so a document may be nested up to MOST_LEVELS deep. Nulls and documents that aren't JSON have no row.
    """
    spark = documents.sparkSession
    level = documents.select(*by, F.lit("$").alias("location"), F.lit("").alias("key"), F.try_parse_json(json).alias("v"))
    nested = lambda c: F.schema_of_variant(c).rlike("^(OBJECT|ARRAY)")
    found = []
    for _ in range(MOST_LEVELS):
        plain = level.filter("v IS NOT NULL").filter(~nested(F.col("v")))
        found.append(plain.select(*by, "location", "key", F.try_variant_get("v", "$", "string").alias("value")).filter("value IS NOT NULL"))
        deeper = level.filter("v IS NOT NULL").filter(nested(F.col("v")))
        if deeper.isEmpty():
            out = found[0]
            for rows in found[1:]:
                out = out.unionByName(rows)
            return out
        each = deeper.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("__pos", "__key", "__value"))
        place = F.when(F.col("__key").isNull(), F.concat("location", F.lit("["), F.col("__pos").cast("string"), F.lit("]"))).otherwise(F.concat("location", F.lit("."), "__key"))
        level = each.select(*by, place.alias("location"), F.coalesce("__key", "key").alias("key"), F.col("__value").alias("v"))
    raise ValueError(f"documents are nested deeper than {MOST_LEVELS} levels")


def found_values(values: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(by, value): of walked values the first filled one under one of the keys, the earlier key first, then by place."""
    rank = F.array_position(F.array(*map(F.lit, keys)), F.col("key"))
    hits = values.filter((rank > 0) & (F.trim("value") != ""))
    return hits.groupBy(*by).agg(F.min(F.struct(rank.alias("rank"), F.length("location").alias("n"), "location", "value"))["value"].alias("value"))


def media_paths(values: DataFrame, by: Sequence[str], endings: Sequence[str] = ("mp4", "mov", "wav", "mp3", "png", "jpg")) -> DataFrame:
    """(by, path, uses): walked values that name a media file, and how often."""
    return values.filter(F.lower("value").rlike(rf"\.({'|'.join(endings)})$")).groupBy(*by, F.col("value").alias("path")).agg(F.count("*").alias("uses"))


def slots(values: DataFrame, by: Sequence[str], endings: Sequence[str] = ("mp4", "mov", "wav", "mp3", "png", "jpg")) -> DataFrame:
    """(by, location, path, slot): places of paths in a document, the same slot for the same path, numbered by first place."""
    rows = values.filter(F.lower("value").rlike(rf"\.({'|'.join(endings)})$")).withColumnRenamed("value", "path")
    first = rows.withColumn("__first", F.min("location").over(Window.partitionBy(*by, "path")))
    number = F.dense_rank().over(Window.partitionBy(*by).orderBy("__first"))
    return first.select(*by, "location", "path", F.concat(F.lit("slot_"), number.cast("string")).alias("slot"))


def flat_text(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, text): all walked values of a document in lower case, by place."""
    return values.groupBy(*by).agg(F.lower(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("location", "value"))), lambda x: x["value"]), " ")).alias("text"))


def with_profile(rows: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """rows with defaults where a column is null or empty, and `applied` and `kept`: which defaults were used and which were not needed."""
    empty = {c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in defaults}
    names = lambda wanted: F.array_join(F.array_compact(F.array(*(F.when(e if wanted else ~e, F.lit(c)) for c, e in empty.items()))), ",")
    told = rows.withColumn("applied", names(True)).withColumn("kept", names(False))
    return told.select(*(F.when(empty[c], defaults[c]).otherwise(F.col(c)).alias(c) if c in defaults else F.col(c) for c in told.columns))


def corrections(lines: DataFrame, by: Sequence[str], line: str = "line") -> DataFrame:
    """(by, wrong, right) of rule lines `wrong => right`, `wrong -> right` or `wrong = right`; blank lines, comments and lines without a rule are left out."""
    rule = r"^\s*([^#\s].*?)\s*(?:=>|->|=)\s*(.*?)\s*$"
    rows = lines.select(*by, F.regexp_extract(line, rule, 1).alias("wrong"), F.regexp_extract(line, rule, 2).alias("right"))
    return rows.filter("wrong <> ''")


def detections(frames: DataFrame, by: Sequence[str], least: float = 0.05, found: str = "detections") -> DataFrame:
    """(by, frame_id, time, label, confidence, x1, y1, x2, y2) of nested detections: a missing time or frame is that of the frame around, a missing label `object`, boxes may be given by size; weak and empty ones are left out."""
    rows = frames.select(*by, F.col("frame_id").alias("__f"), F.col("time").alias("__t"), F.explode(found).alias("d"))
    d = F.col("d")
    x2, y2 = F.coalesce(d["x2"], d["x1"] + d["w"]), F.coalesce(d["y2"], d["y1"] + d["h"])
    flat = rows.select(*by, F.coalesce(F.nullif(d["frame_id"], F.lit("")), "__f").alias("frame_id"), F.coalesce(d["time"], F.col("__t")).alias("time"), F.lower(F.coalesce(F.nullif(F.trim(d["label"]), F.lit("")), F.lit("object"))).alias("label"), F.least(F.lit(1.0), F.coalesce(d["confidence"], F.lit(1.0))).alias("confidence"), d["x1"].alias("x1"), d["y1"].alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return flat.filter((F.col("confidence") >= least) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


# What providers allow; licences that forbid publishing, that ask for credit, and that don't; providers outside; those that need clearance.
POLICIES = {
    "pexels": {"license": "Pexels License", "attribution_required": False, "credit_recommended": True},
    "pixabay": {"license": "Pixabay Content License", "attribution_required": False, "credit_recommended": True},
    "unsplash": {"license": "Unsplash License", "attribution_required": False, "credit_recommended": True},
    "owned": {"license": "Owned / self-produced", "attribution_required": False, "credit_recommended": False},
    "self": {"license": "Owned / self-produced", "attribution_required": False, "credit_recommended": False},
    "generated": {"license": "Generated asset", "attribution_required": False, "credit_recommended": False},
    "codex_imagegen": {"license": "Generated with Codex image_gen / gpt-image-2", "attribution_required": False, "credit_recommended": False},
    "dreamina": {"license": "Generated with Dreamina/Jimeng provider", "attribution_required": False, "credit_recommended": False},
}
BLOCKED_LICENSE = r"(?i)\b(all rights reserved|editorial only|non[- ]?commercial|personal use only|no commercial|rights managed|unknown license)\b"
ATTRIBUTION_LICENSE = r"(?i)\b(cc[- ]?by|creative commons attribution|by-sa|by-nc|by-nd)\b"
NO_ATTRIBUTION_LICENSE = r"(?i)\b(cc0|public domain|pexels|pixabay|unsplash)\b"
EXTERNAL_PROVIDERS = ("pexels", "pixabay", "unsplash", "giphy", "bing", "google", "youtube", "tiktok", "instagram", "web")
NEED_CLEARANCE = ("youtube", "tiktok", "instagram", "web", "bing", "google", "giphy")
# Checks whose ranges are looked at, and the order of their states.
REVIEWED_CHECKS = ("black_frames", "frozen_video", "silence")
STATUS_ORDER = ("fail", "warn", "pass")


def asset_status(provider: Column, licence: Column, source_url: Column, creator: Column, credit: Column, must_credit: Column, cleared: Column, path: Column, there: Column, known_only: bool = False) -> Column:
    """(status, issues, warnings) of an asset: blocked by any issue, warn by any warning, else ready.

    licence and whether credit is due follow from the provider where it has a policy; must_credit and cleared (for commercial use) are null where nothing is
    said. Paths that are addresses count as there.
    """
    policy = lambda field: F.element_at(F.create_map(*(F.lit(x) for name, p in POLICIES.items() for x in (name, p[field]))), F.coalesce(provider, F.lit("")))
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    stated = F.when(text(licence) != "", text(licence)).otherwise(F.coalesce(policy("license"), F.lit("")))
    by_licence = stated.rlike(ATTRIBUTION_LICENSE) & ~stated.rlike(NO_ATTRIBUTION_LICENSE)
    due = F.coalesce(policy("attribution_required"), must_credit, by_licence)
    recommended = F.coalesce(policy("credit_recommended"), F.lit(False))
    remote, url, name, line = path.rlike("(?i)^https?://"), text(source_url), text(creator), text(credit)
    of = lambda names: F.coalesce(provider.isin(*names), F.lit(False))
    incomplete = due & (line == "") & ~((name != "") & (url != ""))
    issues = F.array_compact(F.array(
        F.when(~there & ~remote, "file_missing"), F.when(stated.rlike(BLOCKED_LICENSE), "license_not_publish_safe"), F.when((stated == "") & F.lit(known_only), "license_missing"),
        F.when(of(NEED_CLEARANCE) & (stated == "") & ~F.coalesce(cleared, F.lit(False)), "external_asset_needs_usage_clearance"), F.when(incomplete, "attribution_required_but_incomplete"),
    ))
    warnings = F.array_compact(F.array(
        F.when(remote, "remote_asset_url_not_local_file"), F.when((stated == "") & ~F.lit(known_only), "license_missing"), F.when(of(EXTERNAL_PROVIDERS) & (url == ""), "source_url_missing"),
        F.when(~incomplete & recommended & (line == "") & (name == "") & (url == ""), "credit_metadata_missing"),
    ))
    status = F.when(F.size(issues) > 0, "blocked").when(F.size(warnings) > 0, "warn").otherwise("ready")
    return F.struct(status.alias("status"), F.array_join(issues, ",").alias("issues"), F.array_join(warnings, ",").alias("warnings"))


def option_score(dimensions: Mapping[str, Column], weights: Mapping[str, float], primary: Column, fallback: Column, candidates: Column, lacks: Column) -> Column:
    """Weighted score of an option to 4 places, after its dimensions were shifted, each kept from 0 to 1.

    The primary route fits the task better (+0.08), the fallback is better for continuity (+0.08), any other fits worse (-0.05); candidates at hand make it surer
    and faster (+0.08, +0.06), lacking commands less so (-0.45, -0.15).
    """
    held = {n: F.coalesce(dimensions[n], F.lit(0.0)) if n in dimensions else F.lit(0.0) for n in weights}

    def shift(name: str, when: Column, by: float) -> None:
        if name in held:
            held[name] = F.when(when, F.greatest(F.lit(0.0), F.least(F.lit(1.0), held[name] + by))).otherwise(held[name])

    shift("task_fit", primary, 0.08)
    shift("continuity", ~primary & fallback, 0.08)
    shift("task_fit", ~primary & ~fallback, -0.05)
    shift("reliability", candidates, 0.08)
    shift("latency", candidates, 0.06)
    shift("reliability", lacks, -0.45)
    shift("latency", lacks, -0.15)
    return F.round(sum((held[n] * w for n, w in weights.items()), F.lit(0.0)), 4)


def review_segments(findings: DataFrame, by: Sequence[str], padding: float, most: int, length: str | None = None) -> DataFrame:
    """(by, nth, check, severity, start, end): findings (by, check, severity, start, end) of REVIEWED_CHECKS to look at, failures first, then by time and check, with padding that stays within the media's length (a column, null if unknown); `most` of them."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.coalesce("severity", F.lit("warn"))), F.lit(0)), F.lit(2))
    begin = F.greatest(F.lit(0), F.col("start") - padding)
    end = F.greatest(begin, F.col("end") + padding)
    kept = findings.filter(F.col("check").isin(*REVIEWED_CHECKS)).withColumn("__s", begin).withColumn("__e", F.least(end, F.col(length)) if length else end)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(order, "__s", "check", "__e"))
    return kept.withColumn("nth", nth).filter(F.col("nth") <= most).select(*by, "nth", "check", "severity", F.col("__s").alias("start"), F.col("__e").alias("end"))


def loudest(streams: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, stream, level): of streams (by, stream, level) the loudest, the first of equally loud ones; silent ones (null) only where there is no other."""
    return streams.groupBy(*by).agg(F.min(F.struct(F.col("level").isNull().alias("silent"), (-F.col("level")).alias("less"), "stream", "level")).alias("r")).select(*by, F.col("r.stream").alias("stream"), F.col("r.level").alias("level"))
