"""Queries over subtitle cues: breaking, wrapping and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.functions import layout
from chronoweft.operators import cues
from chronoweft.plans.registry import query
from chronoweft.plans.views import SEGMENTS, segments, table

_CLEAN = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
#: Parts of a text of at most `m` characters, as rows of r(key, language, m, part, rest, k), from r0(key, language, m, rest).
_SPLIT = r"""r AS (SELECT key, language, m, NULL::VARCHAR AS part, rest, 0 AS k FROM r0 WHERE rest <> ''
 UNION ALL SELECT key, language, m, trim(substr(rest, 1, cut)), trim(substr(rest, cut + 1)), k + 1 FROM (SELECT *, CASE WHEN length(rest) <= m THEN length(rest) WHEN mark >= greatest(4, CAST(floor(m * 0.45::DOUBLE) AS INT)) THEN mark WHEN language <> 'zh' AND inside AND hard > 1 THEN hard WHEN language <> 'zh' AND inside THEN m ELSE m END AS cut
  FROM (SELECT *, length(substr(rest, 1, m + 1)) - length(regexp_extract(substr(rest, 1, m + 1), '[^，。！？；：、,.!?;: ]*$')) AS mark, regexp_matches(substr(rest, m, 2), '^[\p{L}\p{N}]{2}') AS inside, m - length(regexp_extract(substr(rest, 1, m), '[\p{L}\p{N}]+$')) AS hard FROM r) WHERE rest <> ''))"""


@query("split_text", rf"""WITH RECURSIVE r0 AS (SELECT conv_id || '/' || turn AS key, conv_id, turn, 'en' AS language, 60 AS m, {_CLEAN} AS rest FROM conversations), {_SPLIT},
g AS (SELECT key, array_to_string(list(part ORDER BY k) FILTER (part IS NOT NULL AND part <> ''), chr(10)) AS parts FROM r GROUP BY key) SELECT conv_id, turn, parts FROM r0 JOIN g USING (key)""")
def split_text(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").filter(layout.compact(F.col("text")) != "")
    return d.select("conv_id", "turn", F.array_join(layout.split_text(F.col("text"), F.lit(60), F.lit("en")), "\n").alias("parts"))


_TWO = r"""n0 AS (SELECT conv_id, turn, text, length(text) AS size, length(text) // 2 AS middle FROM conversations),
n1 AS (SELECT *, coalesce(list_filter(flatten([[middle + o, middle - o] FOR o IN range(0, least(8, middle))]), lambda p: p > 0 AND p < size AND contains(' ,，。、；：！？·', substr(text, p + 1, 1)))[1] + 1, middle) AS a FROM n0),
n2 AS (SELECT *, CASE WHEN regexp_matches(substr(text, a, 2), '^[A-Za-z]{2}') THEN a - length(regexp_extract(substr(text, 1, a), '[A-Za-z]+$')) ELSE a END AS b FROM n1)"""


@query("wrapped_text", rf"""WITH {_TWO}, o AS (SELECT conv_id, turn, text, size, b, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM n2)
SELECT conv_id, turn, CASE WHEN size <= 42 THEN text WHEN turn % 2 = 1 THEN rtrim(substr(text, 1, b), ' ') || '\N' || ltrim(substr(text, b + 1), ' ')
 ELSE list_reduce(ws, lambda t, w: CASE WHEN length(string_split(t, '\N')[-1]) + 1 + length(w) <= 42 THEN t || ' ' || w ELSE t || '\N' || w END) END AS lines FROM o""")
def wrapped_text(spark, sf_dir):
    """Odd turns are wrapped in two, as Chinese is."""
    language = F.when(F.col("turn") % 2 == 1, "zh").otherwise("en")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", layout.wrapped(F.col("text"), 42, language).alias("lines"))


#: Segments with words that share their time evenly: source, id, start, end, text, ws (list of start, end, text).
_WORDS = rf"""{SEGMENTS}, w0 AS (SELECT source, id, start, "end", {_CLEAN} AS text FROM s WHERE "end" > start), w1 AS (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS l FROM w0),
w AS (SELECT source, id, start, "end", text, [{{'start': start + (("end" - start) * (k - 1)) // len(l), 'end': start + (("end" - start) * k) // len(l), 'text': l[k]}} FOR k IN range(1, len(l) + 1)] AS ws FROM w1)"""
_GROUPED = lambda words: rf"""list_reduce([[x] FOR x IN {words}], lambda a, x: CASE WHEN length(a[-1].text || ' ' || x[1].text) > 42 OR x[1]."end" - a[-1].start > 4500 THEN list_concat(a, x)
 ELSE list_concat(a[1:len(a) - 1], [{{'start': a[-1].start, 'end': x[1]."end", 'text': a[-1].text || ' ' || x[1].text}}]) END)"""  # noqa: E731


def _with_words(spark, sf_dir):
    s = segments(spark, sf_dir).filter("end > start").withColumn("text", layout.compact(F.col("text")))
    # The list is bound to a name of its own: Spark puts filters on the words before the projection, and would there split the text again for each word.
    words = F.array(F.filter(F.split("text", " "), lambda w: w != ""))
    at = lambda k, n: F.col("start") + F.floor((F.col("end") - F.col("start")) * k / n)
    timed = F.transform(words, lambda l: F.transform(l, lambda w, k: F.struct(at(k, F.size(l)).alias("start"), at(k + 1, F.size(l)).alias("end"), w.alias("text"))))
    return s.withColumn("words", F.get(timed, F.lit(0)))


@query("word_groups", f"""WITH {_WORDS}, g AS (SELECT source, id, unnest({_GROUPED('ws')}) AS c FROM w WHERE len(ws) > 0) SELECT source, id, c.start AS start, c."end" AS "end", c.text AS text FROM g""")
def word_groups(spark, sf_dir):
    grouped = cues.grouped_words(F.col("words"), F.lit(42), 4500, F.lit("en"))
    return _with_words(spark, sf_dir).select("source", "id", F.inline(grouped))


def _cue_sql(mode: str) -> str:
    first = "500 + start / 1.25::DOUBLE" if mode == "source" else """500 + coalesce(sum(("end" - start) / 1.25::DOUBLE) OVER (PARTITION BY source ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"""
    moved = "[{'start': CAST(round(f + (x.start - start) / 1.25::DOUBLE) AS BIGINT), 'end': CAST(round(f + (x.\"end\" - start) / 1.25::DOUBLE) AS BIGINT), 'text': x.text} FOR x IN ws]"
    return rf"""WITH RECURSIVE {_WORDS}, c AS (SELECT *, {first} AS f, ("end" - start) / 1.25::DOUBLE AS d, source || '/' || id AS key FROM w WHERE text <> ''), r0 AS (SELECT key, 'en' AS language, 42 AS m, text AS rest FROM c WHERE id % 2 = 1), {_SPLIT},
g AS (SELECT source, id, start AS a, "end" AS b, unnest({_GROUPED(moved)}) AS x, generate_subscripts({_GROUPED(moved)}, 1) AS k FROM c WHERE id % 2 = 0),
p AS (SELECT r.key, k, part, coalesce(sum(length(part)) OVER (PARTITION BY r.key ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(length(part)) OVER (PARTITION BY r.key) AS total FROM r WHERE part <> ''),
u AS (SELECT source, id, a, b, k, x.start AS s, x."end" AS e, x.text AS text FROM g
 UNION ALL SELECT source, id, start, "end", k, CAST(round(f + d * before / total) AS BIGINT), CAST(round(f + d * (before + length(part)) / total) AS BIGINT), part FROM p JOIN c USING (key))
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY a, b, id, k) AS INTEGER) AS number, id, greatest(0, s) AS start, greatest(s + 10, e) AS "end", text, length(text) > 42 AS too_long FROM u"""


def _cues(spark, sf_dir, mode):
    clips = _with_words(spark, sf_dir).withColumn("language", F.lit("en"))
    return cues.cues(clips.withColumn("words", F.when(F.col("id") % 2 == 0, F.col("words")).otherwise(F.filter("words", lambda w: F.lit(False)))), ["source"], mode, 1.25, 500)


@query("cues_at_source", _cue_sql("source"))
def cues_at_source(spark, sf_dir):
    """Even turns have words, odd ones only their text."""
    return _cues(spark, sf_dir, "source")


@query("cues_laid_end_to_end", _cue_sql("concat"))
def cues_laid_end_to_end(spark, sf_dir):
    return _cues(spark, sf_dir, "concat")
