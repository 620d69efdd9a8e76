"""What is published around a video: hooks, titles, jobs for its short forms, checklists."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft.functions import text as T

_SLOTS = ("topic", "pain", "proof", "before", "after", "persona")


@dataclass(frozen=True)
class HookFamily:
    """A way to open: a template with slots in braces, a score, and a pattern of the source text that makes it better by a bonus."""

    name: str
    template: str
    score: float
    evidence: str = ""
    bonus: float = 0.05


def contrast_pair(text: Column, topic: Column) -> Column:
    """(before, after) that a text sets against each other: from one to the other, then and now, else the topic and its result."""
    named = r"从(.{1,8})到(.{1,8})"
    short = lambda k: F.substring(F.trim(F.regexp_extract(text, named, k)), 1, 5)
    pair = lambda a, b: F.struct(a.alias("before"), b.alias("after"))
    then = F.contains(text, F.lit("以前")) & F.contains(text, F.lit("现在"))
    return F.when(text.rlike(named), pair(short(1), short(2))).when(then, pair(F.lit("以前"), F.lit("现在"))).when(text.rlike(r"(?i)\b(before|after)\b"), pair(F.lit("before"), F.lit("after"))).otherwise(pair(topic, F.lit("结果")))


def filled(template: str, slots: Mapping[str, Column]) -> Column:
    """A template with its slots filled."""
    parts = [p for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(F.lit(""), *(slots[p[1:-1]] if p[0] == "{" and p[1:-1] in slots else F.lit(p) for p in parts))


def hook(template: str, slots: Mapping[str, Column], most: int, tight: int = 12) -> Column:
    """A filled template; where it is too long its slots are cut to `tight` characters, and then the whole."""
    whole = filled(template, slots)
    tighter = filled(template, {n: F.substring(c, 1, tight) if n in _SLOTS else c for n, c in slots.items()})
    fit = lambda x: F.when(F.length(x["whole"]) <= most, x["whole"]).when(F.length(x["tighter"]) <= most, x["tighter"]).otherwise(F.substring(x["tighter"], 1, most))
    return T.bound(F.struct(whole.alias("whole"), tighter.alias("tighter")), fit)


def hook_variants(rows: DataFrame, by: Sequence[str], families: Sequence[HookFamily], slots: Mapping[str, Column], most: int, text: str = "text") -> DataFrame:
    """(by, number, family, hook, status, score) for each family: blocked where the hook breaks a rule, review where it is long, scored by what the source text offers.

    Each step is a column of its own that the next ones read: written into each other, hooks and rules are more code than Spark compiles.
    """
    made = []
    for k, f in enumerate(families, 1):
        evident = F.col(text).rlike(f"(?i){f.evidence}") if f.evidence else F.lit(False)
        made.append(F.struct(F.lit(k).alias("number"), F.lit(f.name).alias("family"), hook(f.template, slots, most).alias("hook"), F.least(F.lit(0.98), f.score + F.when(evident, f.bonus).otherwise(0.0)).alias("__score")))
    each = rows.select(*by, F.inline(F.array(*made)))
    told = each.withColumn("status", F.when(T.blocked(F.col("hook")), "blocked").when(F.length("hook") > most * 0.9, "review").otherwise("ready"))
    score = F.col("__score") - F.when(F.col("status") == "blocked", 0.3).when(F.col("status") == "review", 0.08).otherwise(0.0)
    return told.select(*by, "number", "family", "hook", "status", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3).alias("score"))


def caption_title(hook_text: Column, keywords: Column, most: int = 18) -> Column:
    """A hook of fitting length as it is, a longer one up to its last mark, else a title made of two keywords."""
    clean = F.trim(F.coalesce(hook_text, F.lit("")))
    cut = F.substring(clean, 1, most)
    out = cut
    for mark in reversed("？！。，、 "):
        last = most - F.instr(F.reverse(F.rpad(cut, most, "x")), F.lit(mark))
        out = F.when((F.instr(cut, F.lit(mark)) > 0) & (last >= 4), F.substring(cut, F.lit(1), last)).otherwise(out)
    first, second = F.get(keywords, F.lit(0)), F.get(keywords, F.lit(1))
    long = F.concat(first, second, F.lit("：3个值得知道的事"))
    named = F.when(F.length(long) <= most, long).otherwise(F.concat(first, second, F.lit("：值得收藏")))
    titles = F.when(F.size(keywords) >= 2, named).when(F.size(keywords) == 1, F.concat(first, F.lit("：值得收藏"))).otherwise("今日分享")
    return F.when(F.length(clean).between(4, most), clean).when(F.length(clean) > most, out).otherwise(titles)


def short_jobs(highlights: DataFrame, by: Sequence[str], basename: str, platform: str, speed: float | None = 1.25, source_exists: Column | None = None) -> DataFrame:
    """Highlights (by, rank, start, end in ms, score) as jobs: id, status, times in seconds, files and the two commands that make and check each short."""
    number = F.concat(F.lit(f"{basename}_"), F.lpad(F.col("rank").cast("string"), F.greatest(F.lit(2), F.length(F.col("rank").cast("string"))), "0"))
    there = F.lit(True) if source_exists is None else source_exists
    jobs = highlights.withColumn("job", number).withColumn("status", F.when(there, "planned").otherwise("blocked"))
    config, video = F.concat(F.lit("work/"), "job", F.lit("_render_config.json")), F.concat(F.lit("output/"), "job", F.lit(".mp4"))
    rate = f" --primary-speed {speed:g}" if speed else ""
    render = F.concat(F.lit("python3 render_final.py --config "), config, F.lit(" --output "), video, F.lit(rate))
    check = F.concat(F.lit("python3 render_qa.py "), video, F.lit(f" --platform {platform} --json verify/"), "job", F.lit("_qa.json"))
    seconds = lambda c: F.round(c / 1000, 3)
    return jobs.select(*by, "job", "status", "rank", "score", seconds(F.col("start")).alias("start"), seconds(F.col("end")).alias("end"), seconds(F.col("end") - F.col("start")).alias("duration"), render.alias("render"), check.alias("check"))


def checklist(projects: DataFrame, by: Sequence[str], platforms: Mapping[str, Sequence[str]], have: str = "have") -> DataFrame:
    """(by, platform, missing, status) for each platform: which of the files that it needs a project (by, have: array) lacks."""
    rows = [F.struct(F.lit(p).alias("platform"), F.array_except(F.array(*map(F.lit, needs)), F.col(have)).alias("missing")) for p, needs in platforms.items()]
    each = projects.select(*by, F.inline(F.array(*rows)))
    return each.withColumn("status", F.when(F.size("missing") > 0, "blocked").otherwise("ready"))


def cover_variants(rows: DataFrame, by: Sequence[str], styles: Sequence[str], title: str, subtitle: str, most: int, least: int = 2) -> DataFrame:
    """(by, number, style, text, problem) of covers: a style and one of two texts in turn, with what is wrong with each."""
    made = []
    for k, style in enumerate(styles):
        line = F.trim(F.col(title if k % 2 == 0 else subtitle))
        problem = F.when(F.coalesce(line, F.lit("")) == "", "no_text").when(F.length(line) < least, "too_short").when(F.length(line) > most, "too_long")
        made.append(F.struct(F.lit(k + 1).alias("number"), F.lit(style).alias("style"), line.alias("text"), problem.alias("problem")))
    return rows.select(*by, F.inline(F.array(*made)))
