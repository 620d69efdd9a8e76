"""Queries over raw transcripts: nested records with gaps and odd values, made from the conversations, cleaned again."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.operators import transcripts as R
from chronoweft.plans.cue_queries import _WORDS, _with_words
from chronoweft.plans.registry import query
from chronoweft.plans.views import SEGMENTS, UNITS, segments, table, units

#: Segments as a transcript has them: r(source, pos, id, segment_id, start, end, text), all but the first two as strings.
_RAW = rf"""{SEGMENTS}, r0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) - 1 AS pos FROM s),
r AS (SELECT source, pos, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 'x' || id ELSE CAST(id AS VARCHAR) END AS id, CASE WHEN id % 3 = 0 THEN CAST(id + 1000 AS VARCHAR) END AS segment_id,
 CASE id % 7 WHEN 3 THEN NULL WHEN 4 THEN 'soon' ELSE printf('%.3f', (start - 2000) / 1000.0::DOUBLE) END AS start,
 CASE id % 6 WHEN 2 THEN printf('%.3f', (start - 2000) / 1000.0::DOUBLE) WHEN 5 THEN NULL ELSE printf('%.3f', ("end" - 2000) / 1000.0::DOUBLE) END AS "end", CASE id % 4 WHEN 3 THEN '   ' ELSE ' ' || text || ' ' END AS text FROM r0),
c AS (SELECT *, TRY_CAST(start AS DOUBLE) AS a, TRY_CAST("end" AS DOUBLE) AS b, trim(text) AS t FROM r)"""


def _raw(spark, sf_dir):
    s = segments(spark, sf_dir)
    seconds = lambda c: F.format_string("%.3f", (F.col(c) - 2000) / 1000)
    i = F.col("id")
    one = F.struct(
        F.col("id").alias("place"),
        F.when(i % 5 == 0, None).when(i % 5 == 1, F.concat(F.lit("x"), i.cast("string"))).otherwise(i.cast("string")).alias("id"),
        F.when(i % 3 == 0, (i + 1000).cast("string")).alias("segment_id"),
        F.when(i % 7 == 3, None).when(i % 7 == 4, "soon").otherwise(seconds("start")).alias("start"),
        F.when(i % 6 == 2, seconds("start")).when(i % 6 == 5, None).otherwise(seconds("end")).alias("end"),
        F.when(i % 4 == 3, "   ").otherwise(F.concat(F.lit(" "), "text", F.lit(" "))).alias("text"),
    )
    return s.groupBy("source").agg(F.sort_array(F.collect_list(one)).alias("segments"))


@query("ranked_segments", f"""WITH {_RAW} SELECT source, CAST(coalesce(TRY_CAST(id AS INTEGER), pos + 1) AS INTEGER) AS id, round(a, 3) AS start, round(b, 3) AS "end", t AS text FROM c WHERE b > a AND t <> ''""")
def ranked_segments(spark, sf_dir):
    return R.ranked_segments(_raw(spark, sf_dir), ["source"])


@query("bad_segments", f"""WITH {_RAW} SELECT source, CAST(pos AS INTEGER) AS pos, CASE WHEN a IS NULL THEN 'start is no number' ELSE 'end is no number' END AS problem FROM c WHERE a IS NULL OR b IS NULL""")
def bad_segments(spark, sf_dir):
    return R.bad_segments(_raw(spark, sf_dir), ["source"])


@query("clamped_segments", f"""WITH {_RAW} SELECT source, CAST(coalesce(TRY_CAST(id AS INTEGER), pos + 1) AS INTEGER) AS id, round(greatest(0, a), 4) AS start, round(greatest(0, b), 4) AS "end", round(greatest(0, b - a), 4) AS duration, t AS text FROM c WHERE b > a""")
def clamped_segments(spark, sf_dir):
    return R.clamped_segments(_raw(spark, sf_dir), ["source"])


@query("storyboard_segments", f"""WITH {_RAW} SELECT source, CAST(coalesce(nullif(TRY_CAST(id AS INTEGER), 0), nullif(TRY_CAST(segment_id AS INTEGER), 0), pos + 1) AS INTEGER) AS id, coalesce(a, 0) AS start, greatest(coalesce(a, 0), coalesce(b, a, 0)) AS "end", t AS text FROM c WHERE t <> ''""")
def storyboard_segments(spark, sf_dir):
    return R.storyboard_segments(_raw(spark, sf_dir), ["source"])


@query("transcript_duration", f"""WITH {_RAW}, d AS (SELECT source, max(CASE WHEN b > a THEN b END) AS last FROM c GROUP BY source)
SELECT source, round(coalesce(CASE WHEN source % 3 = 1 THEN 12.5 END, last, 0), 4)::DOUBLE AS duration FROM d""")
def transcript_duration(spark, sf_dir):
    """A third of the transcripts declare 12.5 s, others 0 or nothing sensible."""
    t = _raw(spark, sf_dir).withColumn("duration", F.when(F.col("source") % 3 == 1, "0").otherwise("n/a")).withColumn("audio_duration", F.when(F.col("source") % 3 == 1, "12.5"))
    return R.duration_of(t, ["source"], ["duration", "audio_duration"])


@query("transcript_words", f"""WITH {_WORDS}, x AS (SELECT source, id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM w), t AS (SELECT source, id, k, w.text AS text, w.start / 1000::DOUBLE AS a, w."end" / 1000::DOUBLE AS b, CASE WHEN k % 5 = 0 THEN 'spacing' WHEN k % 7 = 0 THEN 'Audio_Event' END AS type FROM x),
top AS (SELECT source, min(id) AS first FROM t GROUP BY source) SELECT source, round(a, 3) AS start, round(b, 3) AS "end", text FROM t JOIN top USING (source) WHERE type IS NULL AND b > a AND (source % 2 = 0 OR id = first)""")
def transcript_words(spark, sf_dir):
    """Odd sources have the words of their first segment at the top, which then count alone."""
    kind = lambda k: F.when(k % 5 == 0, "spacing").when(k % 7 == 0, "Audio_Event")
    words = F.transform("words", lambda w, k: F.struct(kind(k + 1).alias("type"), w["text"].alias("text"), (w["start"] / 1000).alias("start"), (w["end"] / 1000).alias("end")))
    s = _with_words(spark, sf_dir).filter(F.size("words") > 0).select("source", "id", words.alias("words"))
    t = s.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("id", "words"))).alias("segments"))
    return R.words_of(t.withColumn("words", F.when(F.col("source") % 2 == 1, F.col("segments")[0]["words"])), ["source"])


@query("diarization_json", f"""WITH {UNITS} SELECT source, start / 1000::DOUBLE AS start, CASE WHEN id % 4 = 3 THEN start / 1000::DOUBLE + ("end" - start) / 1000::DOUBLE ELSE "end" / 1000::DOUBLE END AS "end", CASE WHEN id % 5 = 4 THEN 'SPEAKER_00' ELSE speaker END AS speaker
FROM u WHERE "end" > start AND id % 11 <> 10""")
def diarization_json(spark, sf_dir):
    """One document a unit, each in one of several shapes and with other names of its fields."""
    u = units(spark, sf_dir)
    number = lambda c: F.format_string("%.3f", c / 1000)
    start, end, i = F.col("start"), F.col("end"), F.col("id")
    begin = F.element_at(F.array(*map(F.lit, ("start", "start_time", "begin", "from"))), (i % 4 + 1).cast("int"))
    stop = F.element_at(F.array(*map(F.lit, ("end", "endTime", "stop", "duration"))), (i % 4 + 1).cast("int"))
    until = F.when(i % 4 == 3, number(end - start)).otherwise(number(end))
    who = F.when(i % 5 == 4, "other").when(i % 5 == 3, "who").otherwise("speaker_id")
    item = F.concat(F.lit('{"'), begin, F.lit('":'), F.when(i % 11 == 10, '"never"').otherwise(number(start)), F.lit(',"'), stop, F.lit('":'), until, F.lit(',"'), who, F.lit('":" '), "speaker", F.lit(' "}'))
    shape = F.element_at(F.array(*map(F.lit, ("[%]", '{"turns":[%]}', '{"result":{"entries":[%]}}', '{"speakerSegments":[%],"other":1}'))), (F.floor(i / 4) % 4 + 1).cast("int"))
    return R.diarization(u.select("source", F.replace(shape, F.lit("%"), item).alias("json")), ["source"])


_PEOPLE = f"""{UNITS}, p AS (SELECT source, id, start, "end", CASE WHEN id % 3 = 0 THEN ' guest ' WHEN id % 3 = 1 THEN '' END AS existing FROM u WHERE speaker = 'view' AND "end" > start),
d AS (SELECT source, start, "end", speaker FROM u WHERE speaker <> 'view' AND "end" > start AND id % 2 = 0)"""
_NEAREST = """q AS (SELECT p.source, p.id, first(d.speaker ORDER BY abs((d.start + d."end") / 2.0::DOUBLE - (p.start + p."end") / 2.0::DOUBLE), (d.start + d."end") / 2.0::DOUBLE, d.start, d."end", d.speaker) AS nearest FROM p JOIN d USING (source) GROUP BY p.source, p.id)"""


def _people(spark, sf_dir):
    u = units(spark, sf_dir).filter("end > start")
    p = u.filter("speaker = 'view'").select("source", "id", "start", "end", F.when(F.col("id") % 3 == 0, " guest ").when(F.col("id") % 3 == 1, "").alias("existing"))
    return p, u.filter("speaker <> 'view' AND id % 2 = 0").select("source", "start", "end", "speaker")


@query("nearest_speaker", f"WITH {_PEOPLE}, {_NEAREST} SELECT p.source, p.id, nearest FROM p LEFT JOIN q USING (source, id)")
def nearest_speaker(spark, sf_dir):
    p, d = _people(spark, sf_dir)
    return R.nearest_speaker(p, d, ["source"]).select("source", "id", "nearest")


@query("filled_speakers", f"""WITH {_PEOPLE}, {_NEAREST}, o AS (SELECT p.source, p.id, d.speaker, sum(least(p."end", d."end") - greatest(p.start, d.start)) AS score, min({{'s': d.start, 'e': d."end"}}) AS first FROM p JOIN d ON p.source = d.source AND p.start < d."end" AND d.start < p."end" GROUP BY ALL),
b AS (SELECT source, id, sum(score) AS total, first(speaker ORDER BY score DESC, first, speaker) AS assigned, list_sort(list(score), 'DESC')[2] AS second FROM o GROUP BY source, id)
SELECT p.source, p.id, coalesce(assigned, nullif(trim(existing), ''), nearest, 'unknown') AS speaker, CASE WHEN assigned IS NOT NULL THEN least(1.0, total / (p."end" - p.start)::DOUBLE) WHEN trim(coalesce(existing, '')) <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS coverage,
 CASE WHEN assigned IS NOT NULL THEN concat_ws(',', CASE WHEN total / (p."end" - p.start)::DOUBLE < 0.5 THEN 'low_overlap' END, CASE WHEN coalesce(second, 0) / total::DOUBLE >= 0.25 THEN 'mixed' END) WHEN trim(coalesce(existing, '')) <> '' THEN '' WHEN nearest IS NOT NULL THEN 'nearest_speaker_fill' ELSE 'unlabeled' END AS warnings
FROM p LEFT JOIN b USING (source, id) LEFT JOIN q USING (source, id)""")
def filled_speakers(spark, sf_dir):
    p, d = _people(spark, sf_dir)
    return R.speakers(p, d, ["source"], 36_000_000, fill_nearest=True).drop("start", "end")


@query("decorated_turns", """SELECT conv_id, turn, role AS speaker, CASE role WHEN 'user' THEN 'The guest' WHEN 'assistant' THEN 'Host' ELSE coalesce(role, 'unknown') END AS display_name, CASE role WHEN 'assistant' THEN 'host' END AS role, CASE role WHEN 'user' THEN '#fff' END AS color FROM conversations""")
def decorated_turns(spark, sf_dir):
    names = spark.createDataFrame([("user", "", "The guest", "x", "", "#fff"), ("assistant", None, "", "Host", "host", None), ("nobody", "n", "n", "n", "n", "n")], "speaker string, display_name string, name string, label string, role string, color string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"))
    return R.decorated(turns, names).select("conv_id", "turn", "speaker", "display_name", "role", "color")


_TOKENS = r"""t AS (SELECT conv_id, turn, [CASE WHEN contains('aeiou', x[1]) THEN '(' || x WHEN x[1] = 's' THEN ', ' WHEN x[1] = 't' THEN '字' ELSE x END FOR x IN regexp_extract_all(lower(text), '[a-z]+')] AS ts FROM conversations)"""


def _tokens(spark, sf_dir):
    odd = lambda x: F.when(x.rlike("^[aeiou]"), F.concat(F.lit("("), x)).when(x.startswith("s"), ", ").when(x.startswith("t"), "字").otherwise(x)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), odd).alias("ts"))


@query("joined_parts", rf"""WITH {_TOKENS} SELECT conv_id, turn, trim(regexp_replace(coalesce(list_reduce([trim(x) FOR x IN ts], lambda a, p: CASE WHEN contains(',.!?;:%)]}}，。！？；：、）》】', p[1]) OR contains('([{{（《【', a[-1]) OR regexp_matches(a[-1] || p[1], '[\x{{3400}}-\x{{9fff}}]') THEN a || p ELSE a || ' ' || p END), ''), '\s+([,.;:!?%])', '\1', 'g')) AS text FROM t""")
def joined_parts(spark, sf_dir):
    return _tokens(spark, sf_dir).select("conv_id", "turn", R.joined_parts(F.col("ts")).alias("text"))


@query("displayed_tokens", rf"""WITH {_TOKENS} SELECT conv_id, turn, coalesce(list_reduce(ts, lambda a, p: CASE WHEN regexp_matches(p, '^[\x{{3400}}-\x{{9fff}}]$') OR regexp_matches(a, '[\x{{3400}}-\x{{9fff}}]$') THEN a || p ELSE a || ' ' || p END), '') AS text FROM t""")
def displayed_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("conv_id", "turn", R.displayed_tokens(F.col("ts")).alias("text"))


@query("match_text", r"SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', '', 'g') AS text FROM documents")
def match_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.match_text(F.col("text")).alias("text"))


@query("normal_text", r"SELECT conv_id, turn, regexp_replace(replace(replace(lower(text), 'the', ''), 'und', ''), '[^a-z0-9\x{4e00}-\x{9fff}]+', '', 'g') AS text FROM conversations")
def normal_text(spark, sf_dir):
    """As for Chinese, whose fillers aren't whole words."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.normal_text(F.col("text"), ("the", "und"), "zh").alias("text"))


@query("chapter_titles", r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^[ 。.!?,，、：:;；]+|[ 。.!?,，、：:;；]+$', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN 'Chapter ' || doc_id WHEN contains(t, ' ') THEN array_to_string(string_split(t, ' ')[1:7], ' ') ELSE substr(t, 1, 18) END AS title FROM c""")
def chapter_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.chapter_title(F.col("text"), F.col("doc_id")).alias("title"))


_SPOKEN = f"""{_WORDS}, x AS (SELECT source, unnest(ws) AS w FROM w), k AS (SELECT source, w.start AS start, w."end" AS "end", w.text AS text, row_number() OVER (PARTITION BY source ORDER BY w.start, w."end", w.text) AS k FROM x WHERE w."end" > w.start),
q AS (SELECT *, regexp_matches(text, '[.!?。！？；;]["''”’）)】]*$') AS ends, lead(start) OVER (PARTITION BY source ORDER BY k) AS next FROM k), cut AS (SELECT source, id, start + 777 AS "at" FROM s UNION ALL SELECT source, 10000 + id, -500 FROM s)"""


def _spoken(spark, sf_dir):
    w = _with_words(spark, sf_dir).select("source", F.inline("words")).filter("end > start")
    s = segments(spark, sf_dir)
    cuts = s.select("source", "id", (F.col("start") + 777).alias("at")).unionByName(s.select("source", (F.col("id") + 10000).alias("id"), F.lit(-500).cast("long").alias("at")))
    return w, cuts


@query("sentence_ends", f"""WITH {_SPOKEN}, h AS (SELECT cut.source, id, "at", coalesce(max(CASE WHEN start <= "at" + 1 THEN k END), min(CASE WHEN "end" BETWEEN "at" AND "at" + 3000 THEN k END)) AS k FROM cut LEFT JOIN q ON q.source = cut.source GROUP BY ALL),
e AS (SELECT h.source, h.id, min(n.k) AS j FROM h JOIN q ON q.source = h.source AND q.k = h.k JOIN q n ON n.source = h.source AND n.k > h.k AND n.ends WHERE NOT q.ends GROUP BY ALL),
m AS (SELECT e.source, e.id, e.j, max(q."end") AS reach FROM e JOIN h USING (source, id) JOIN q ON q.source = e.source AND q.k > h.k AND q.k <= e.j GROUP BY ALL),
g AS (SELECT h.*, m.j IS NOT NULL AND reach <= "at" + 3000 AS extends, CASE WHEN m.j IS NOT NULL AND reach <= "at" + 3000 THEN j ELSE h.k END AS target FROM h LEFT JOIN m USING (source, id))
SELECT g.source, id, "at", coalesce(least(q."end" + 300, q.next), "at") AS moved, CASE WHEN g.k IS NULL THEN 'unchanged_no_word_nearby' WHEN extends THEN 'extended_to_sentence_end' WHEN q.ends THEN 'sentence_end' ELSE 'word_end' END AS reason FROM g LEFT JOIN q ON q.source = g.source AND q.k = g.target""")
def sentence_ends(spark, sf_dir):
    w, cuts = _spoken(spark, sf_dir)
    return R.sentence_ends(w, ["source"], cuts, 3000, 300)


_QUIET = f"""{UNITS}, w AS (SELECT source, id, start, "end", "end" + 900000 AS target FROM u WHERE speaker = 'view'), z AS (SELECT source, start, "end", (start + "end") / 2.0::DOUBLE AS middle FROM u WHERE speaker <> 'view' AND "end" > start)"""


def _quiet(spark, sf_dir):
    u = units(spark, sf_dir)
    return u.filter("speaker = 'view'").withColumn("target", F.col("end") + 900_000), u.filter("speaker <> 'view' AND end > start")


@query("silence_before", f"""WITH {_QUIET} SELECT w.source, id, first(middle ORDER BY z."end" DESC, middle DESC) AS middle FROM w JOIN z ON w.source = z.source AND middle BETWEEN w.start - 9000000 AND w.start AND z."end" <= w.start + 50 GROUP BY w.source, id""")
def silence_before(spark, sf_dir):
    return R.silence_before(*_quiet(spark, sf_dir), ["source"], 9_000_000, 36_000_000)


@query("silence_after", f"""WITH {_QUIET} SELECT w.source, id, first(middle ORDER BY abs(middle - target), middle) AS middle FROM w JOIN z ON w.source = z.source AND middle BETWEEN w."end" AND w."end" + 9000000 AND z.start >= w."end" - 50 GROUP BY w.source, id""")
def silence_after(spark, sf_dir):
    return R.silence_after(*_quiet(spark, sf_dir), ["source"], 9_000_000, 36_000_000)
