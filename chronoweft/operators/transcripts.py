"""Transcripts as they come, with missing, odd and differently named fields, as clean timed rows; and who speaks in them."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.functions import layout
from chronoweft.operators import joins
from chronoweft.operators.graph import cut_lineage

# Names that readers know a field by, the first that is filled counts.
START_NAMES = ("start", "start_time", "startTime", "begin", "from", "timestamp")
END_NAMES = ("end", "end_time", "endTime", "stop", "to")
SPEAKER_NAMES = ("speaker", "speaker_id", "speakerId", "label", "name", "who")
LIST_NAMES = ("segments", "speaker_segments", "speakerSegments", "diarization", "turns", "entries", "items")
UNKNOWN = "unknown"
_CJK = "[\\u3400-\\u9fff]"


def _numbered(transcripts: DataFrame, by: Sequence[str], segments: str) -> DataFrame:
    return transcripts.select(*by, F.posexplode(segments).alias("__pos", "__raw"))


def _seconds(c: Column) -> Column:
    return c.try_cast("double")


def ranked_segments(transcripts: DataFrame, by: Sequence[str], segments: str = "segments") -> DataFrame:
    """(by, id, start, end, text) of an array of raw segments (id, start, end, text as strings): those with text and a positive length, times to 3 places.

    id is the whole number given, else the place from 1. Segments whose times are no numbers are left out; see bad_segments.
    """
    raw = F.col("__raw")
    rows = _numbered(transcripts, by, segments).select(*by, F.coalesce(raw["id"].try_cast("int"), F.col("__pos") + 1).alias("id"), _seconds(raw["start"]).alias("start"), _seconds(raw["end"]).alias("end"), F.trim(F.coalesce(raw["text"], F.lit(""))).alias("text"))
    kept = rows.filter("end > start AND text <> ''")
    return kept.select(*by, "id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


def bad_segments(transcripts: DataFrame, by: Sequence[str], segments: str = "segments") -> DataFrame:
    """(by, pos, problem) of raw segments whose start or end is missing or no number."""
    raw = F.col("__raw")
    rows = _numbered(transcripts, by, segments)
    problem = F.when(_seconds(raw["start"]).isNull(), "start is no number").when(_seconds(raw["end"]).isNull(), "end is no number")
    return rows.select(*by, F.col("__pos").alias("pos"), problem.alias("problem")).filter("problem IS NOT NULL")


def clamped_segments(transcripts: DataFrame, by: Sequence[str], segments: str = "segments") -> DataFrame:
    """(by, id, start, end, duration, text): as ranked_segments, but blank texts stay and times are at least 0, to 4 places."""
    raw = F.col("__raw")
    rows = _numbered(transcripts, by, segments).select(*by, F.coalesce(raw["id"].try_cast("int"), F.col("__pos") + 1).alias("id"), _seconds(raw["start"]).alias("start"), _seconds(raw["end"]).alias("end"), F.trim(F.coalesce(raw["text"], F.lit(""))).alias("text"))
    least = lambda c: F.round(F.greatest(F.lit(0.0), c), 4)
    return rows.filter("end > start").select(*by, "id", least(F.col("start")).alias("start"), least(F.col("end")).alias("end"), least(F.col("end") - F.col("start")).alias("duration"), "text")


def storyboard_segments(transcripts: DataFrame, by: Sequence[str], segments: str = "segments") -> DataFrame:
    """(by, id, start, end, text): segments with text; a missing start is 0, an end that is missing or too early is the start. id falls back to segment_id, then to the place from 1."""
    raw = F.col("__raw")
    start = F.coalesce(_seconds(raw["start"]), F.lit(0.0))
    number = lambda c: F.nullif(c.try_cast("int"), F.lit(0))
    rows = _numbered(transcripts, by, segments).filter(F.trim(F.coalesce(raw["text"], F.lit(""))) != "")
    return rows.select(*by, F.coalesce(number(raw["id"]), number(raw["segment_id"]), F.col("__pos") + 1).alias("id"), start.alias("start"), F.greatest(start, F.coalesce(_seconds(raw["end"]), start)).alias("end"), F.trim(raw["text"]).alias("text"))


def words_of(transcripts: DataFrame, by: Sequence[str], words: str = "words", segments: str = "segments") -> DataFrame:
    """(by, start, end, text) of the words of a transcript: its own list, or those of its segments if that has none.

    Words are (type, text, start, end); spacing and audio events are no words, nor is anything without text or length.
    """
    spoken = lambda w: ~F.lower(F.coalesce(w["type"], F.lit("word"))).isin("spacing", "audio_event") & (F.trim(F.coalesce(w["text"], F.lit(""))) != "") & (w["end"] > w["start"])
    empty = F.expr(f"filter({words}, x -> false)")
    own = F.filter(F.coalesce(F.col(words), empty), spoken)
    nested = F.filter(F.flatten(F.transform(F.coalesce(F.col(segments), F.expr(f"filter({segments}, x -> false)")), lambda s: s["words"])), spoken)
    chosen = F.when(F.size(own) > 0, own).otherwise(nested)
    return transcripts.select(*by, F.explode(chosen).alias("w")).select(*by, F.round("w.start", 3).alias("start"), F.round("w.end", 3).alias("end"), F.trim("w.text").alias("text"))


def duration_of(transcripts: DataFrame, by: Sequence[str], declared: Sequence[str], segments: str = "segments") -> DataFrame:
    """(by, duration): the first declared duration above 0, else the last end of a segment."""
    positive = [F.when(_seconds(F.col(c)) > 0, _seconds(F.col(c))) for c in declared]
    last = F.array_max(F.transform(segments, lambda s: F.when(_seconds(s["end"]) > _seconds(s["start"]), _seconds(s["end"]))))
    return transcripts.select(*by, F.round(F.coalesce(*positive, last, F.lit(0.0)), 4).alias("duration"))


def diarization(documents: DataFrame, by: Sequence[str], json: str = "json") -> DataFrame:
    """(by, start, end, speaker) of diarization documents in JSON: lists of segments under any of LIST_NAMES, at the top or in `result`, or a list at the top.

    A segment's end may be given as a duration; one without a speaker is named by its place; those without a start or a length are left out.
    """
    field = "struct<" + ",".join(f"{c}:string" for c in (*START_NAMES, *END_NAMES, "duration", *SPEAKER_NAMES)) + ">"
    lists = ",".join(f"{c}:array<{field}>" for c in LIST_NAMES)
    top = F.from_json(F.col(json), f"struct<{lists},result:struct<{lists}>>")
    bare = F.from_json(F.when(F.ltrim(json).startswith("["), F.concat(F.lit('{"segments":'), F.col(json), F.lit("}"))), f"struct<{lists}>")
    parsed = documents.select(*by, top.alias("__top"), bare.alias("__bare"))
    found = [F.col(f"{where}.{c}") for where in ("__bare", "__top", "__top.result") for c in LIST_NAMES]
    indexed = F.flatten(F.array_compact(F.array(*(F.transform(c, lambda s, i: F.struct(i.alias("i"), s.alias("s"))) for c in found))))
    rows = parsed.select(*by, F.inline(indexed))
    first = lambda names: F.coalesce(*(F.col(f"s.{c}").try_cast("double") for c in names))
    filled = lambda c: F.nullif(layout.compact(F.col(f"s.{c}")), F.lit(""))
    start = first(START_NAMES)
    end = F.coalesce(first(END_NAMES), start + F.col("s.duration").try_cast("double"))
    speaker = F.coalesce(*(filled(c) for c in SPEAKER_NAMES), F.concat(F.lit("SPEAKER_"), F.lpad(F.col("i").cast("string"), 2, "0")))
    return rows.select(*by, start.alias("start"), end.alias("end"), speaker.alias("speaker")).filter("end > start")


def nearest_speaker(units: DataFrame, spoken: DataFrame, by: Sequence[str]) -> DataFrame:
    """units (by, start, end, ...) with `nearest`: the speaker of the row of spoken (by, start, end, speaker) whose middle is closest; of equally close ones the earlier."""
    middle = (F.col("start") + F.col("end")) / 2
    at = units.withColumn("mid_point", middle)
    marks = spoken.withColumn("__m", middle).groupBy(*by, "__m").agg(F.min(F.struct("start", "end", "speaker")).alias("__r"))
    near = joins.nearest(at, marks.select(*by, F.col("__m").alias("mid_point")), by, "mid_point", "mid_point", None, "__m")
    return near.join(marks, [*by, "__m"], "left").withColumn("nearest", F.col("__r.speaker")).select(*units.columns, "nearest")


def speakers(units: DataFrame, spoken: DataFrame, by: Sequence[str], width: int, fill_nearest: bool = False, low_coverage: float = 0.5, mixed: float = 0.25) -> DataFrame:
    """Units (by, id, start, end, existing) with `speaker`, coverage and warnings.

    The speaker with most overlap, else the unit's own existing one, else, if asked for, the nearest one, else `unknown`.
    """
    own = units.select(*by, "id", F.nullif(layout.compact(F.col("existing")), F.lit("")).alias("existing"))
    found = joins.assign_speakers(units, spoken, by, width, low_coverage, mixed, ("start", "end")).join(own, [*by, "id"])
    overlaps = F.col("assigned") != "unknown"
    found = nearest_speaker(found, spoken, by) if fill_nearest else found.withColumn("nearest", F.lit(None).cast("string"))
    heard, given = ~F.contains("warnings", F.lit("unlabeled")) | overlaps, F.col("existing").isNotNull()
    speaker = F.when(heard, F.col("assigned")).otherwise(F.coalesce("existing", "nearest", F.lit(UNKNOWN)))
    warnings = F.when(heard, F.col("warnings")).when(given, "").when(F.col("nearest").isNotNull(), "nearest_speaker_fill").otherwise("unlabeled")
    coverage = F.when(~heard & given, 1.0).otherwise(F.col("coverage"))
    return found.select(*by, "id", "start", "end", speaker.alias("speaker"), coverage.alias("coverage"), warnings.alias("warnings"))


def decorated(turns: DataFrame, names: DataFrame, key: str = "speaker") -> DataFrame:
    """turns with display_name, role and colour of their speaker in names (key, display_name, name, label, role, color); the speaker's own name where none is filled."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    told = names.select(key, F.coalesce(filled("display_name"), filled("name"), filled("label")).alias("__name"), filled("role").alias("role"), filled("color").alias("color"))
    return turns.join(told, key, "left").withColumn("display_name", F.coalesce("__name", key, F.lit(UNKNOWN))).drop("__name")


def joined_parts(parts: Column) -> Column:
    """Texts side by side: with a space, but none before a closing mark, after an opening bracket or next to a Chinese character."""
    clean = F.filter(F.transform(parts, layout.compact), lambda p: p != "")
    closing, opening = r"^[,.!?;:%)\]}，。！？；：、）》】]", r"[(\[{（《【]$"

    def step(acc: Column, part: Column) -> Column:
        edge = F.concat(F.right(acc, F.lit(1)), F.left(part, F.lit(1)))
        tight = part.rlike(closing) | acc.rlike(opening) | edge.rlike(_CJK)
        return F.when(acc == "", part).when(tight, F.concat(acc, part)).otherwise(F.concat(acc, F.lit(" "), part))

    return F.trim(F.regexp_replace(F.aggregate(clean, F.lit(""), step), r"\s+([,.;:!?%])", "$1"))


def displayed_tokens(tokens: Column) -> Column:
    """Tokens side by side: with a space, but none before a single Chinese character or after one."""
    tight = lambda acc, t: t.rlike(f"^{_CJK}$") | acc.rlike(f"{_CJK}$")
    return F.aggregate(tokens, F.lit(""), lambda acc, t: F.when(acc == "", t).when(tight(acc, t), F.concat(acc, t)).otherwise(F.concat(acc, F.lit(" "), t)))


def match_text(text: Column) -> Column:
    """Letters and digits of any script in lower case, nothing else: what texts are compared by. Compatibility forms aren't folded."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def normal_text(text: Column, fillers: Sequence[str], language: str) -> Column:
    """Lower case without fillers: letters and digits of ASCII, and Chinese characters if that is the language."""
    out = F.lower(text)
    for f in fillers:
        out = F.replace(out, F.lit(f), F.lit("")) if language == "zh" else F.regexp_replace(out, rf"\b\Q{f}\E\b", " ")
    return F.regexp_replace(out, "[^a-z0-9\\u4e00-\\u9fff]+" if language == "zh" else "[^a-z0-9]+", "")


def chapter_title(text: Column, index: Column) -> Column:
    """The first seven words, or the first 18 characters of a text without spaces; `Chapter n` for one without text."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), r"^[ 。.!?,，、：:;；]+|[ 。.!?,，、：:;；]+$", "")
    words = F.array_join(F.slice(F.split(clean, " "), 1, 7), " ")
    return F.when(clean == "", F.concat(F.lit("Chapter "), index.cast("string"))).when(F.contains(clean, F.lit(" ")), words).otherwise(F.substring(clean, 1, 18))


_SENTENCE_END = r"""[.!?。！？；;]["'”’）)】]*$"""


def numbered_words(words: DataFrame, by: Sequence[str]) -> DataFrame:
    """words (by, start, end, text) with k, their place by start, whether they end a sentence, and next: the start of the word after."""
    w = Window.partitionBy(*by).orderBy("start", "end", "text")
    return words.withColumn("k", F.row_number().over(w)).withColumn("ends", F.rtrim("text").rlike(_SENTENCE_END)).withColumn("next", F.lead("start").over(w))


def sentence_ends(words: DataFrame, by: Sequence[str], cuts: DataFrame, window: float, padding: float) -> DataFrame:
    """cuts (by, id, at) with `moved` and `reason`: to the end of the word spoken at the cut, or of its sentence if all words up to there end within window.

    The word is the last that starts by 1 ms after the cut, or without one the first that ends within window. padding is added, but not beyond the next word's start.
    """
    rows = numbered_words(words, by)
    back = Window.partitionBy(*by).orderBy(F.desc("k"))
    # Words share a group with the sentence end that follows; the group is counted from the back.
    group = F.sum(F.col("ends").cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__g", group)
    # From the back what follows is a running value; a frame that ends with the group would be read anew for each word.
    later = Window.partitionBy(*by, "__g").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__reach", F.max("end").over(later)).withColumn("__last", F.first(F.struct("end", "next", "ends")).over(later))
    # What a cut has to know of a word; written once, as it is read for the cuts after a word and for those before all words.
    facts = cut_lineage(rows.select(*by, F.struct("start", "end", "next", "ends", "__reach", "__last").alias("__w"), "start", "end", "k"), "words")
    # Words and cuts in one order, a cut after the words that start by 1 ms after it: the word is the last before it.
    known = functools.reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in (*by, "start")))
    order = Window.partitionBy(*by).orderBy("__at", "__cut", "k").rowsBetween(Window.unboundedPreceding, 0)
    placed = facts.filter(known).select(*by, F.col("start").alias("__at"), F.lit(0).alias("__cut"), "k", F.col("__w").alias("__word"))
    asked = cuts.select(*by, "id", "at", (F.col("at") + 1).alias("__at"), F.lit(1).alias("__cut"))
    both = asked.unionByName(placed, allowMissingColumns=True)
    behind = both.withColumn("__w", F.last("__word", ignorenulls=True).over(order)).filter("__cut = 1").select(*by, "id", "at", "__w")
    # Without a word before it: the first word, by place, whose end is in the window; ends are looked up by buckets as long as the window, each time once.
    width = max(window, 1)
    alone = behind.filter("__w IS NULL").select(*by, "at").distinct()
    sought = alone.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("at") / width), F.floor((F.col("at") + window) / width))))
    ending = facts.select(*by, "k", "end", F.col("__w").alias("__f"), F.floor(F.col("end") / width).alias("__bucket"))
    first = sought.join(ending, [*by, "__bucket"]).filter((F.col("end") >= F.col("at")) & (F.col("end") <= F.col("at") + window)).groupBy(*by, "at").agg(F.min_by("__f", "k").alias("__f"))
    joined = behind.join(first, [*by, "at"], "left").withColumn("__w", F.coalesce("__w", "__f"))
    word = F.col("__w")
    extends = ~word["ends"] & word["__last"]["ends"] & (word["__reach"] <= F.col("at") + window)
    end = F.when(extends, word["__last"]["end"]).otherwise(word["end"]) + padding
    follows = F.when(extends, word["__last"]["next"]).otherwise(word["next"])
    reason = F.when(word.isNull(), "unchanged_no_word_nearby").when(extends, "extended_to_sentence_end").when(word["ends"], "sentence_end").otherwise("word_end")
    return joined.select(*by, "id", "at", F.when(word.isNull(), F.col("at")).otherwise(F.least(end, follows)).alias("moved"), reason.alias("reason"))


def _with_silences(words: DataFrame, silences: DataFrame, by: Sequence[str], low: Column, high: Column, width: int) -> DataFrame:
    """words with the silences whose middle is from low to high, both included; by buckets of the middle."""
    middles = silences.select(*by, F.col("start").alias("s_start"), F.col("end").alias("s_end"), ((F.col("start") + F.col("end")) / 2).alias("middle"))
    middles = middles.withColumn("__b", F.floor(F.col("middle") / width))
    spread = words.withColumn("__low", low).withColumn("__high", high).withColumn("__b", F.explode(F.sequence(F.floor(F.col("__low") / width), F.floor(F.col("__high") / width))))
    return spread.join(middles, [*by, "__b"]).filter(F.col("middle").between(F.col("__low"), F.col("__high")))


def silence_before(words: DataFrame, silences: DataFrame, by: Sequence[str], window: float, width: int, slack: float = 50) -> DataFrame:
    """(by, id, middle) for words (by, id, start): the middle of the silence that ends last among those that end by the word's start, give or take slack, with their middle within window before it."""
    near = _with_silences(words.select(*by, "id", "start"), silences, by, F.col("start") - window, F.col("start"), width).filter(F.col("s_end") <= F.col("start") + slack)
    return near.groupBy(*by, "id").agg(F.max(F.struct("s_end", "middle"))["middle"].alias("middle"))


def silence_after(words: DataFrame, silences: DataFrame, by: Sequence[str], window: float, width: int, slack: float = 50) -> DataFrame:
    """(by, id, middle) for words (by, id, end, target): the middle closest to the target among silences that start by the word's end or later, give or take slack, with their middle within window after it."""
    near = _with_silences(words.select(*by, "id", "end", "target"), silences, by, F.col("end"), F.col("end") + window, width).filter(F.col("s_start") >= F.col("end") - slack)
    return near.groupBy(*by, "id").agg(F.min(F.struct(F.abs(F.col("middle") - F.col("target")).alias("far"), "middle"))["middle"].alias("middle"))


def matches_of(rules: Mapping[str, str]) -> Column:
    """Names of the patterns that a column `text` matches, in the order of the rules."""
    return F.array_compact(F.array(*(F.when(F.col("text").rlike(f"(?i){p}"), F.lit(name)) for name, p in rules.items())))
