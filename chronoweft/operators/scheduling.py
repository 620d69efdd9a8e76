"""Cues and plans drawn from what is said: stickers, sounds, badges, pictures; edit plans from directives; checks before a render."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.operators import greedy

# Fixed value: a badge stays so many ms at least.
LEAST_BADGE = 600


def stickers(segments: DataFrame, by: Sequence[str], feelings: Mapping[str, Sequence[str]], pools: Mapping[str, int], least_gap: float) -> DataFrame:
    """(by, start, id, feeling, sticker): segments (by, start, id, text) that show a feeling, each least_gap or more after the one before; stickers of a timeline are dealt in turn from the feeling's pool."""
    low = F.lower("text")
    feeling = F.lit(None).cast("string")
    for name in reversed(list(feelings)):
        feeling = F.when(low.rlike("|".join(rf"\Q{w}\E" for w in feelings[name])), name).otherwise(feeling)
    felt = segments.withColumn("feeling", feeling).filter("feeling IS NOT NULL")
    taken = greedy.cooldown(felt, by, "start", least_gap, ["id"])
    n = F.row_number().over(Window.partitionBy(*by).orderBy("start", "id")) - 1
    size = F.element_at(F.create_map(*(F.lit(x) for pair in pools.items() for x in pair)), F.col("feeling"))
    return taken.withColumn("sticker", (n % size).cast("int")).select(*by, "start", "id", "feeling", "sticker")


def sounds(segments: DataFrame, by: Sequence[str], words: Mapping[str, Sequence[str]], least_gap: float, most: int) -> DataFrame:
    """(by, start, id, sound): as stickers, for sound effects: `most` of a timeline."""
    low = F.lower("text")
    sound = F.lit(None).cast("string")
    for name in reversed(list(words)):
        sound = F.when(low.rlike("|".join(rf"\Q{w}\E" for w in words[name])), name).otherwise(sound)
    heard = segments.withColumn("sound", sound).filter("sound IS NOT NULL")
    return greedy.cooldown(heard, by, "start", least_gap, ["id"], most).select(*by, "start", "id", "sound")


def badges(turns: DataFrame, by: Sequence[str], length: float, least_gap: float) -> DataFrame:
    """(by, speaker, start, end): a badge at the start of a turn (by, speaker, start, end, times in ms), not again within least_gap while the same speaker goes on; it lasts `length`, or as long as the turn, but LEAST_BADGE.

    Another speaker's turn in between, an unknown one's too, makes the next badge due at once; turns that don't last count for nothing.
    """
    who = F.coalesce("speaker", F.lit("unknown"))
    rows = turns.withColumn("speaker", who).filter("end > start OR speaker = 'unknown'")
    order = Window.partitionBy(*by).orderBy("start", "end", "speaker")
    rows = rows.withColumn("__changed", F.when(F.lag("speaker").over(order) == F.col("speaker"), 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__changed").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("speaker <> 'unknown'")
    shown = greedy.cooldown(rows.select(*by, "__run", "speaker", "start", "end"), [*by, "__run", "speaker"], "start", least_gap, ["end"])
    return shown.select(*by, "speaker", "start", (F.col("start") + F.least(F.lit(length), F.greatest(F.lit(LEAST_BADGE), F.col("end") - F.col("start")))).alias("end"))


def opportunities(segments: DataFrame, by: Sequence[str], templates: Mapping[str, Sequence[str]]) -> DataFrame:
    """(by, id, template, second): the first template one of whose words a segment says; of several in one second of a template the first."""
    low = F.lower("text")
    template = F.lit(None).cast("string")
    for name in reversed(list(templates)):
        template = F.when(low.rlike("|".join(rf"\Q{w}\E" for w in templates[name])), name).otherwise(template)
    rows = segments.withColumn("template", template).filter("template IS NOT NULL").withColumn("second", F.round(F.col("start") / 1000).cast("long"))
    first = F.row_number().over(Window.partitionBy(*by, "template", "second").orderBy("start", "id"))
    return rows.withColumn("__k", first).filter("__k = 1").select(*by, "id", "template", "second")


def directed(segments: DataFrame, directives: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, id, action, problem): what directives (by, id, action) say of segments (by, id): the action if all agree; problems are a directive without a segment, several that differ, and a segment without one."""
    told = directives.groupBy(*by, "id").agg(F.min("action").alias("action"), F.count_distinct("action").alias("__kinds"), F.count("*").alias("__n"))
    both = segments.select(*by, "id", F.lit(True).alias("__there")).join(told, [*by, "id"], "full")
    problem = F.when(F.col("__there").isNull(), "missing_segment").when(F.col("__kinds") > 1, "conflict").when(F.col("__n") > 1, "duplicate").when(F.col("__n").isNull(), "unreviewed")
    return both.select(*by, "id", F.when(F.col("__kinds") == 1, F.col("action")).alias("action"), problem.alias("problem"))


def merged_cues(own: DataFrame, added: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, kind, start, end, origin): cues of a configuration and those of a plan that it doesn't have yet (same kind and start)."""
    cue = lambda rows, origin: rows.select(*by, "kind", "start", "end", F.lit(origin).alias("origin"))
    new = added.dropDuplicates([*by, "kind", "start", "end"]).join(own.select(*by, "kind", "start"), [*by, "kind", "start"], "left_anti")
    return cue(own, "config").unionByName(cue(new, "plan"))


def stock_plan(terms: DataFrame, by: Sequence[str], providers: Sequence[str], per_page: int, seconds: float) -> DataFrame:
    """(by, term, provider, wanted, enough): a search at each provider for each term, and whether all of them together give `seconds` a term (clips of 5 s)."""
    each = terms.select(*by, "term", F.explode(F.array(*map(F.lit, providers))).alias("provider")).withColumn("wanted", F.lit(per_page))
    return each.withColumn("enough", F.sum("wanted").over(Window.partitionBy(*by, "term")) * 5.0 >= seconds)


def consistent_offsets(offsets: DataFrame, measured: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    """(by, left, right, implied, direct, divergence, consistent): measured offsets of pairs of angles (by, left, right, direct) against the difference of their offsets (by, angle, offset)."""
    of = lambda side: offsets.select(*by, F.col("angle").alias(side), F.col("offset").alias(f"__{side}"))
    both = measured.join(of("left"), [*by, "left"]).join(of("right"), [*by, "right"]).withColumn("implied", F.col("__right") - F.col("__left"))
    gap = F.abs(F.col("direct") - F.col("implied"))
    return both.select(*by, "left", "right", F.round("implied", 4).alias("implied"), F.round("direct", 4).alias("direct"), F.round(gap, 4).alias("divergence"), (gap <= threshold).alias("consistent"))


def sync_status(confidence: Column, margin: Column, offset: Column, given: Column, least_confidence: float, most_offset: float) -> Column:
    """(status, warnings) of an alignment of sound to picture: an offset given by hand is ready; one that was measured must be sure, clear and not at the end of the search."""
    weak, close, edge = confidence < least_confidence, margin < 0.05, F.abs(offset) >= most_offset
    warnings = F.when(given, "").otherwise(F.concat_ws(",", F.when(confidence.isNull(), "not_measured"), F.when(weak, "low_confidence"), F.when(close, "ambiguous"), F.when(edge, "at_search_limit")))
    return F.struct(F.when(given | (warnings == ""), "ready").when(confidence.isNull() | weak, "blocked").otherwise("review").alias("status"), warnings.alias("warnings"))


def preflight(findings: DataFrame, subjects: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, blocking, warnings, status, first): findings (by, code, severity) rolled up for every subject; first is the first blocking code."""
    counted = findings.groupBy(*by).agg(F.count_if(F.col("severity") == "block").alias("blocking"), F.count_if(F.col("severity") == "warn").alias("warnings"), F.min(F.when(F.col("severity") == "block", F.col("code"))).alias("first"))
    both = subjects.select(*by).distinct().join(counted, list(by), "left").fillna(0, ["blocking", "warnings"])
    return both.withColumn("status", F.when(F.col("blocking") > 0, "blocked").when(F.col("warnings") > 0, "review").otherwise("ready"))


def probe_times(start: Column, end: Column, count: int, seconds: float) -> Column:
    """Starts of `count` probes of a length, spread evenly over a range; one in its middle where they don't all fit."""
    room = end - start - seconds
    even = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.round(start + room * i / max(1, count - 1), 3))
    return F.when(room >= seconds * (count - 1), even).when(room >= 0, F.array(F.round(start + room / 2, 3))).otherwise(F.array().cast("array<double>"))


def whole_number_at(json: Column, path: str) -> Column:
    """The whole number at a path of a JSON text; 0 where there is none."""
    return F.coalesce(F.get_json_object(json, path).try_cast("int"), F.lit(0))


def rhythm_deltas(metrics: DataFrame, by: Sequence[str], pairs: DataFrame, tolerances: Mapping[str, float]) -> DataFrame:
    """(by of a, other, metric, delta, within): how far the metrics of a timeline are from those of the one that it should follow (pairs: by, other)."""
    key = by[0]
    like = metrics.select(F.col(key).alias("other"), *(F.col(m).alias(f"__{m}") for m in tolerances))
    both = pairs.join(metrics, list(by)).join(like, "other")
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.round(F.abs(F.col(m) - F.col(f"__{m}")), 6).alias("delta"), (F.abs(F.col(m) - F.col(f"__{m}")) <= t).alias("within")) for m, t in tolerances.items()))
    return both.select(*by, "other", F.inline(each))
