"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.functions import text as T
from chronoweft.functions import timecode
from chronoweft.plans.registry import query
from chronoweft.plans.views import UNITS, segments, table, units

_FILLERS = ("the", "that", "this")


@query("tokens", "SELECT doc_id, len(regexp_extract_all(lower(text), '[一-鿿]|[a-z0-9]+')) AS tokens, greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9'']+'))) AS words FROM documents")
def tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("tokens"), T.token_count(F.col("text"), F.lit("en")).cast("long").alias("words"))


@query("clipped_text", r"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 42 THEN t ELSE rtrim(substr(t, 1, 41)) || '...' END AS clipped FROM c""")
def clipped_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clipped(F.col("text")).alias("clipped"))


@query("display_units", r"""SELECT doc_id, len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) + len(regexp_extract_all(text, '\s')) * 0.3::DOUBLE + (length(text) - len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) - len(regexp_extract_all(text, '\s'))) * 0.55::DOUBLE AS units FROM documents""")
def display_units(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.display_units(F.col("text")).alias("units"))


@query("filler_words", r"""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(lower(text), '\bthe\b') THEN 'the' END, CASE WHEN regexp_matches(lower(text), '\bthat\b') THEN 'that' END, CASE WHEN regexp_matches(lower(text), '\bthis\b') THEN 'this' END) AS found,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\bthe\b', ' ', 'g'), '\bthat\b', ' ', 'g'), '\bthis\b', ' ', 'g'), '[^a-z0-9]+', '', 'g') AS normal FROM documents WHERE lang = 'en'""")
def filler_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("lang = 'en'")
    return d.select("doc_id", F.array_join(T.fillers(F.col("text"), _FILLERS), ",").alias("found"), T.without_fillers(F.col("text"), _FILLERS).alias("normal"))


@query("signal_score", r"""SELECT doc_id, least(1.0, least(0.32 * len(regexp_extract_all(text, '(?i)why\b|how\b')), 0.32 * 1.8) + least(0.2 * len(regexp_extract_all(text, '\d+')), 0.2 * 1.8))::DOUBLE AS score FROM documents""")
def signal_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.signal_score(F.col("text"), {"question": ((r"why\b|how\b",), 0.32), "data": ((r"\d+",), 0.2)}).alias("score"))


@query("keyword_top_terms", r"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM w WHERE length(term) >= 3 AND term NOT IN ('the', 'that') GROUP BY ALL)
SELECT lang, term, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS INTEGER) AS rank FROM c QUALIFY rank <= 20""")
def keyword_top_terms(spark, sf_dir):
    return T.top_terms(table(spark, sf_dir, "documents"), ["lang"], "text", 20, 3, ("the", "that"))


@query("guard_scan", r"""WITH m AS (SELECT doc_id, 'diversion-url' AS category, unnest(regexp_extract_all(text, '(?i)(?:https?://|www\.|\.com|\.cn|\.net)')) AS matched FROM documents
 UNION ALL SELECT doc_id, 'diversion-phone', unnest(regexp_extract_all(text, '\b1[3-9]\d{9}\b')) FROM documents UNION ALL SELECT doc_id, 'diversion-wechat', unnest(regexp_extract_all(text, '(?i)\b(?:vx|wx)\b')) FROM documents
 UNION ALL SELECT doc_id, 'diversion-qq', unnest(regexp_extract_all(text, '(?i)\bqq\b')) FROM documents UNION ALL SELECT doc_id, 'diversion-wechat', unnest(regexp_extract_all(text, '(?i)\+\s*v\b')) FROM documents)
SELECT doc_id, 'hard' AS level, category, matched FROM m""")
def guard_scan(spark, sf_dir):
    return T.violations(table(spark, sf_dir, "documents"), ["doc_id"], "text")


# RE2 has no look-ahead: what must not follow is taken as one more character or the end.
_GUARD = "|".join(f"(?:{p})" for patterns in T.GUARD_RULES.values() for p in patterns).replace("(?![0-9百千万亿])", "(?:[^0-9百千万亿]|$)").replace("'", "''")


@query("guard_gate", f"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i){_GUARD}') THEN 'blocked' WHEN length(text) > 800 OR len(regexp_extract_all(text, '{T.EMOJI}')) > 0.3 * greatest(length(text), 1) THEN 'review' ELSE 'ready' END AS status FROM documents""")
def guard_gate(spark, sf_dir):
    """Gate on whole texts with all rules."""
    return table(spark, sf_dir, "documents").select("doc_id", T.gate(F.col("text")).alias("status"))


@query("guard_gate_titles", f"""WITH t AS (SELECT conv_id, turn, string_split(text, chr(10))[1] AS title FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(title, '(?i){_GUARD}') THEN 'blocked' WHEN length(title) > 20 OR regexp_matches(title, '!!!|！！！|\\?\\?\\?|？？？|。。。|\\.\\.\\.') OR len(regexp_extract_all(title, '{T.EMOJI}')) > 0.3 * greatest(length(title), 1) THEN 'review' ELSE 'ready' END AS status FROM t""")
def guard_gate_titles(spark, sf_dir):
    """Gate on titles, the first line of each turn, with what only titles must not have."""
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.element_at(F.split("text", "\n"), 1).alias("title"))
    found = T.violations(d, ["conv_id", "turn"], "title", context="title").groupBy("conv_id", "turn").agg(F.count_if(F.col("level") == "hard").alias("hard"), F.count("*").alias("all"))
    return d.join(found, ["conv_id", "turn"], "left").select("conv_id", "turn", F.when(F.col("hard") > 0, "blocked").when(F.col("all") > 0, "review").otherwise("ready").alias("status"))


_BIGRAMS = lambda c: f"list_distinct([substr({c}, i, 2) FOR i IN range(1, length({c}))])"


@query("bigram_jaccard", f"""WITH n AS (SELECT doc_id, lower(substr(text, 1, length(text) // 2)) AS a, lower(substr(text, length(text) // 2 + 1)) AS b FROM documents WHERE length(text) >= 4), g AS (SELECT doc_id, {_BIGRAMS("a")} AS x, {_BIGRAMS("b")} AS y FROM n)
SELECT doc_id, len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) AS likeness FROM g""")
def bigram_jaccard(spark, sf_dir):
    """The first half of each whole text against the second."""
    half = F.floor(F.length("text") / 2).cast("int")
    d = table(spark, sf_dir, "documents").filter(F.length("text") >= 4).select("doc_id", F.lower(F.substring("text", F.lit(1), half)).alias("a"), F.lower(F.substring("text", half + 1, F.length("text"))).alias("b"))
    return d.select("doc_id", T.jaccard(T.character_ngrams(F.col("a")), T.character_ngrams(F.col("b"))).alias("likeness"))


@query("bigram_jaccard_turns", f"""WITH n AS (SELECT conv_id, turn, lower(text) AS a, lower(lead(text) OVER w) AS b, lead(turn) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT conv_id, turn, CASE WHEN length(a) >= 2 THEN {_BIGRAMS("a")} WHEN length(a) = 1 THEN [a] ELSE [] END AS x, CASE WHEN length(b) >= 2 THEN {_BIGRAMS("b")} WHEN length(b) = 1 THEN [b] ELSE [] END AS y FROM n WHERE t = turn + 1)
SELECT conv_id, turn, coalesce(len(list_intersect(x, y))::DOUBLE / nullif(len(list_distinct(list_concat(x, y))), 0), 0) AS likeness FROM g""")
def bigram_jaccard_turns(spark, sf_dir):
    """Each whole turn of a conversation against the whole next one."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("text").alias("a"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", T.jaccard(T.character_ngrams(F.col("a")), T.character_ngrams(F.col("b"))).alias("likeness"))


@query("timecodes", f"""WITH {UNITS}, m AS (SELECT id, ("end" - start) AS ms FROM u), f AS (SELECT id, ms, CAST(round_even(ms / 1000.0::DOUBLE * 25, 0) AS BIGINT) AS frames, ((ms + 5) // 10) * 10 AS cs FROM m)
SELECT id, frames, printf('%02d:%02d:%02d:%02d', (frames // 25) // 3600, (frames // 1500) % 60, (frames // 25) % 60, frames % 25) AS timecode,
 printf('%02d:%02d:%02d,%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS srt, printf('%d:%02d:%02d.%02d', cs // 3600000, (cs // 60000) % 60, (cs // 1000) % 60, (cs % 1000) // 10) AS ass,
 CASE WHEN ms // 1000 >= 3600 THEN printf('%d:%02d:%02d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60) ELSE printf('%d:%02d', ms // 60000, (ms // 1000) % 60) END AS chapter FROM f""")
def timecodes(spark, sf_dir):
    m = units(spark, sf_dir).select("id", (F.col("end") - F.col("start")).alias("ms"))
    frames = timecode.seconds_to_frames(F.col("ms") / 1000, 25)
    return m.select("id", frames.alias("frames"), timecode.timecode(frames, 25).alias("timecode"), timecode.srt_time(F.col("ms")).alias("srt"), timecode.ass_time(F.col("ms")).alias("ass"), timecode.chapter_time(F.floor(F.col("ms") / 1000)).alias("chapter"))


@query("parse_clock", f"""WITH {UNITS} SELECT id, ((("end" - start) // 3600000) * 3600 + ((("end" - start) // 60000) % 60) * 60 + (("end" - start) // 1000) % 60)::DOUBLE AS seconds FROM u""")
def parse_clock(spark, sf_dir):
    ms = F.col("end") - F.col("start")
    clock = F.concat_ws(":", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60)
    return units(spark, sf_dir).select("id", timecode.parse_clock(clock).alias("seconds"))


@query("segment_language", "SELECT conv_id AS source, turn AS id, CASE WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' ELSE 'en' END AS language FROM conversations")
def segment_language(spark, sf_dir):
    return segments(spark, sf_dir).select("source", "id", T.infer_language(F.col("text")).alias("language"))
