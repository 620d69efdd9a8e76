"""Subtitle cues from timed clips: words packed into cues, or a clip's text shared out over its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.functions import layout

# Characters of a cue by language.
MOST_CHARS = {"zh": 18, "en": 42}
MOST_MILLIS = 4500


def joined_words(a: Column, b: Column, language: Column) -> Column:
    """Two texts side by side: with a space, or none in Chinese, where none stands before a mark either."""
    chinese = F.regexp_replace(F.concat(a, b), r"\s+([，。！？；：、,.!?;:])", "$1")
    return F.when(language == "zh", chinese).otherwise(F.concat(a, F.lit(" "), b))


def grouped_words(words: Column, most_chars: Column, most_millis: int, language: Column) -> Column:
    """Words, an array of (start, end, text) in order, as an array of cues of the same form: a word joins the cue before it unless that gets too long to read or to show."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,text:string>>")

    def step(cues: Column, word: Column) -> Column:
        last = F.try_element_at(cues, F.lit(-1))
        text = joined_words(last["text"], word["text"], language)
        apart = (F.size(cues) == 0) | (F.length(text) > most_chars) | (word["end"] - last["start"] > most_millis)
        longer = F.struct(last["start"].alias("start"), word["end"].alias("end"), text.alias("text"))
        return F.when(apart, F.concat(cues, F.array(word))).otherwise(F.concat(F.slice(cues, F.lit(1), F.size(cues) - 1), F.array(longer)))

    return F.aggregate(words, none, step)


def shared_out(parts: Column, start: Column, length: Column) -> Column:
    """Parts of a text, an array, as cues of (start, end, text), each as long as its share of the characters."""
    units = lambda p: F.greatest(F.lit(1), F.length(p))
    total = F.aggregate(parts, F.lit(0), lambda acc, p: acc + units(p))
    before = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda acc, p: acc + units(p))
    at = lambda i: F.round(start + length * before(i) / total).cast("long")
    return F.transform(parts, lambda p, i: F.struct(at(i).alias("start"), at(i + 1).alias("end"), p.alias("text")))


def cues(clips: DataFrame, by: Sequence[str], mode: str, speed: float = 1.0, offset: int = 0, most_chars: int | None = None, most_millis: int = MOST_MILLIS) -> DataFrame:
    """(by, number, id, start, end, text, too_long) of clips (by, id, start, end in ms, text, language, words: array of (start, end, text) or empty).

    mode `source` keeps the clips' times, `concat` lays them end to end. Times are divided by speed and moved by offset. A clip with words
    has its words packed, one without its text split and shared out. Cues last 10 ms at least.
    """
    rows = clips.filter("end > start").withColumn("text", layout.compact(F.col("text"))).filter("text <> ''")
    length = (F.col("end") - F.col("start")) / speed
    before = Window.partitionBy(*by).orderBy("start", "end", "id").rowsBetween(Window.unboundedPreceding, -1)
    first = F.lit(offset) + (F.col("start") / speed if mode == "source" else F.coalesce(F.sum(length).over(before), F.lit(0.0)))
    rows = rows.withColumn("__first", first).withColumn("__length", length)
    most = F.lit(most_chars) if most_chars else F.when(F.col("language") == "zh", MOST_CHARS["zh"]).otherwise(MOST_CHARS["en"])
    moved = lambda t: F.round(F.col("__first") + (t - F.col("start")) / speed).cast("long")
    words = F.transform(F.filter("words", lambda w: (w["text"] != "") & (w["end"] >= F.col("start")) & (w["start"] <= F.col("end"))), lambda w: F.struct(moved(F.greatest(w["start"], F.col("start"))).alias("start"), moved(F.least(w["end"], F.col("end"))).alias("end"), w["text"].alias("text")))
    rows = rows.withColumn("__most", most).withColumn("__words", words).withColumn("__parts", layout.split_text(F.col("text"), F.col("__most"), F.col("language")))
    made = F.when(F.size("__words") > 0, grouped_words(F.col("__words"), F.col("__most"), most_millis, F.col("language"))).otherwise(shared_out(F.col("__parts"), F.col("__first"), F.col("__length")))
    each = rows.select(*by, F.col("id"), F.col("start").alias("__from"), F.col("end").alias("__to"), "__most", F.posexplode(made).alias("__k", "__cue"))
    order = Window.partitionBy(*by).orderBy("__from", "__to", "id", "__k")
    start = F.greatest(F.lit(0), F.col("__cue.start"))
    return each.select(*by, F.row_number().over(order).alias("number"), "id", start.alias("start"), F.greatest(F.col("__cue.start") + 10, F.col("__cue.end")).alias("end"), F.col("__cue.text").alias("text"), (F.length("__cue.text") > F.col("__most")).alias("too_long"))
