"""What a project holds: files by kind and category, artifacts, claims, cues and takes of a plan, references that don't resolve."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.operators import catalog


def path_tokens(path: Column) -> Column:
    """Words of a path in lower case."""
    return F.filter(F.split(F.lower(path), "[^a-z0-9]+"), lambda t: t != "")


def inventory(files: DataFrame, by: Sequence[str], categories: Mapping[str, Sequence[str]], path: str = "path", default: str = "other") -> DataFrame:
    """(by, kind, category, files, bytes): files (by, path, length) counted once a path, by what they are and by the first category that their path names."""
    once = files.groupBy(*by, path).agg(F.max("length").alias("length"))
    rows = once.withColumn("kind", catalog.media_kind(F.col(path))).withColumn("category", catalog.first_class(path_tokens(F.col(path)), categories, default))
    return rows.groupBy(*by, "kind", "category").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def artifacts(files: DataFrame, by: Sequence[str], patterns: Mapping[str, Sequence[str]], excludes: Sequence[str], path: str = "path", modified: str = "modified") -> DataFrame:
    """(by, category, path, nth) of files whose path matches a pattern of a category and none of the excluded folders; nth counts from the newest."""
    parts = F.split(F.col(path), "/")
    kept = files.filter(~F.arrays_overlap(parts, F.array(*map(F.lit, excludes)))) if excludes else files
    fits = [F.when(F.col(path).rlike("|".join(f"(?:{p})" for p in ps)), F.lit(name)) for name, ps in patterns.items()]
    rows = kept.select(*by, path, modified, F.explode(F.array_compact(F.array(*fits))).alias("category"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by, "category").orderBy(F.desc(modified), path))).select(*by, "category", path, "nth")


def claims(lines: DataFrame, by: Sequence[str], line: str = "line") -> DataFrame:
    """(by, claim, url, kind, screenshot) of lines `claim | url | kind | screenshot`; parts that are missing or blank are null, lines without a claim are left out."""
    parts = F.split(F.col(line), r"\|")
    part = lambda k: F.nullif(F.trim(F.get(parts, F.lit(k))), F.lit(""))
    return lines.select(*by, part(0).alias("claim"), part(1).alias("url"), F.lower(part(2)).alias("kind"), part(3).alias("screenshot")).filter("claim IS NOT NULL")


def whole_numbers(text: Column) -> Column:
    """The whole numbers of a list in text, in order; what is no number is left out."""
    return F.array_compact(F.transform(F.split(F.coalesce(text, F.lit("")), r"[,\s]+"), lambda t: t.try_cast("int")))


def plan_cues(plans: DataFrame, by: Sequence[str], kinds: Mapping[str, str], seconds: float = 2.0) -> DataFrame:
    """(by, kind, start, end, label): cues of several arrays of a plan (each of start, end, duration, label) as one set of segments; kinds: column -> kind.

    A cue without an end lasts its duration, or `seconds`; cues without a start or a length are left out.
    """
    out = None
    for column, kind in kinds.items():
        cue = plans.select(*by, F.explode(column).alias("c"))
        start = F.col("c.start")
        end = F.coalesce(F.col("c.end"), start + F.coalesce(F.col("c.duration"), F.lit(seconds)))
        rows = cue.select(*by, F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.col("c.label").alias("label")).filter("end > start")
        out = rows if out is None else out.unionByName(rows)
    return out


def shots_with_assets(shots: DataFrame, assets: DataFrame, by: Sequence[str], key: str = "shot_id") -> DataFrame:
    """shots with path and status of their asset, of several the first by path; `unresolved` where there is none."""
    one = assets.filter("path IS NOT NULL AND path <> ''").groupBy(*by, key).agg(F.min("path").alias("path"))
    return shots.join(one, [*by, key], "left").withColumn("status", F.when(F.col("path").isNull(), "unresolved").otherwise("resolved"))


def with_overrides(sources: DataFrame, overrides: DataFrame, key: str = "label", value: str = "media") -> DataFrame:
    """(key, value, problem): sources with the value of their override, else their own; overrides that name no source are orphans, sources without a value unset."""
    told = overrides.select(key, F.col(value).alias("__told"), F.lit(True).alias("__over"))
    both = sources.select(key, value, F.lit(True).alias("__own")).join(told, key, "full")
    problem = F.when(F.col("__own").isNull(), "orphan_override").when(F.coalesce("__told", value).isNull(), "unset")
    return both.select(key, F.coalesce("__told", value).alias(value), problem.alias("problem"))


def takes(units: DataFrame, phrases: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, units, events, phrases, duration): what each source of units (by, end, kind) and phrases holds."""
    counted = units.groupBy(*by).agg(F.count("*").alias("units"), F.count_if(F.col("kind") == "audio_event").alias("events"), F.max("end").alias("duration"))
    return counted.join(phrases.groupBy(*by).agg(F.count("*").alias("phrases")), list(by), "left").fillna(0, ["phrases"])


# Shares of energy and onset in a feature.
ENERGY, ONSET = 0.8, 0.2


def sync_features(rows: DataFrame, by: Sequence[str], frame: str = "frame", value: str = "value", floor: float = 0.2) -> DataFrame:
    """rows with `feature`: four parts of the value above the noise floor of its key, in shares of its range, and one of how much that rose since the frame before.

    The floor is the value at round((n - 1) * floor), half to even; a key whose values hardly differ has features of 0.
    """
    ordered = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(value))).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    edges = ordered.groupBy(*by).agg(F.min(F.when(F.col("__k") - 1 == F.bround((F.col("__n") - 1) * floor), F.col(value))).alias("__low"), F.max(value).alias("__high"))
    span = F.col("__high") - F.col("__low")
    energy = F.when(span <= 1e-9, 0.0).otherwise(F.greatest(F.lit(0.0), (F.col(value) - F.col("__low")) / span))
    shares = rows.join(edges, list(by)).withColumn("__e", energy)
    onset = F.greatest(F.lit(0.0), F.col("__e") - F.coalesce(F.lag("__e").over(Window.partitionBy(*by).orderBy(frame)), F.lit(0.0)))
    return shares.withColumn("feature", ENERGY * F.col("__e") + ONSET * onset).drop("__low", "__high", "__e")


def window_features(values: np.ndarray, floor: float = 0.2) -> np.ndarray:
    """sync_features of windows whose values lie in rows of an array, by place."""
    low = np.sort(values, axis=1)[:, [round((values.shape[1] - 1) * floor)]]
    span = values.max(axis=1, keepdims=True) - low
    energy = np.where(span <= 1e-9, 0.0, np.maximum(0.0, (values - low) / np.where(span <= 1e-9, 1.0, span)))
    onset = np.maximum(0.0, np.diff(energy, axis=1, prepend=0.0))
    return ENERGY * energy + ONSET * onset
