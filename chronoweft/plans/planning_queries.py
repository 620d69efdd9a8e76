"""Queries over plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.functions import layout, selectors
from chronoweft.operators import planning
from chronoweft.plans.registry import query
from chronoweft.plans.views import SEGMENTS, UNITS, segments, table, units


@query("highlights")
def highlights(spark, sf_dir):
    return planning.highlights(segments(spark, sf_dir), ["source"], 20_000, 45_000, 90_000, 3)


_AT = f"""{UNITS}, a AS (SELECT source, id, start, "end" FROM u WHERE speaker = 'view'), m AS (SELECT DISTINCT source, start AS t FROM u WHERE speaker <> 'view')"""


@query("scene_snap", f"""WITH {_AT}, e AS (SELECT a.*, CASE WHEN a.start - m.t <= 5000000 THEN m.t END AS early FROM a ASOF LEFT JOIN m ON a.source = m.source AND a.start >= m.t),
l AS (SELECT e.*, CASE WHEN m.t - e."end" <= 5000000 THEN m.t END AS late FROM e ASOF LEFT JOIN m ON e.source = m.source AND e."end" <= m.t), n AS (SELECT *, coalesce(early, start) AS s, coalesce(late, "end") AS z FROM l)
SELECT source, id, CASE WHEN z - s <= 40000000 THEN s ELSE start END AS snapped_start, CASE WHEN z - s <= 40000000 THEN z ELSE "end" END AS snapped_end FROM n""")
def scene_snap(spark, sf_dir):
    u = units(spark, sf_dir)
    marks = u.filter("speaker <> 'view'").select("source", F.col("start").alias("at"))
    return planning.scene_snapped(u.filter("speaker = 'view'").select("source", "id", "start", "end"), marks, ["source"], 5_000_000, 40_000_000).select("source", "id", "snapped_start", "snapped_end")


@query("word_start", f"""WITH {UNITS}, c AS (SELECT source, id, start AS t FROM u WHERE speaker = 'view'), w AS (SELECT source, start AS s, "end" AS e FROM u WHERE speaker <> 'view' AND "end" > start),
i AS (SELECT c.source, c.id, min(w.s) AS within FROM c JOIN w ON c.source = w.source AND w.s < c.t AND c.t < w.e GROUP BY ALL), n AS (SELECT c.source, c.id, min(w.s) AS next FROM c JOIN w ON c.source = w.source AND w.s BETWEEN c.t AND c.t + 9000000 GROUP BY ALL),
b AS (SELECT c.source, c.id, max(w.s) AS prior FROM c JOIN w ON c.source = w.source AND w.s BETWEEN c.t - 9000000 AND c.t GROUP BY ALL)
SELECT c.source, c.id, coalesce(within, next, prior, t) AS moved, CASE WHEN within IS NOT NULL THEN 'word_start' WHEN next IS NOT NULL THEN 'next_word_start' WHEN prior IS NOT NULL THEN 'nearest_word_start' ELSE 'unchanged' END AS reason
FROM c LEFT JOIN i USING (source, id) LEFT JOIN n USING (source, id) LEFT JOIN b USING (source, id)""")
def word_start(spark, sf_dir):
    u = units(spark, sf_dir)
    cuts = u.filter("speaker = 'view'").select("source", "id", F.col("start").alias("at"))
    return planning.word_start(cuts, u.filter("speaker <> 'view' AND end > start"), ["source"], 9_000_000, 36_000_000).select("source", "id", "moved", "reason")


@query("chapters", f"""WITH RECURSIVE {SEGMENTS}, n AS (SELECT source, CASE WHEN k = 1 THEN 0 ELSE start END AS start, speaker AS title, k, duration FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY start, speaker) AS k, max("end") OVER (PARTITION BY source) AS duration FROM s)),
r AS (SELECT source, k, start, title, duration, start AS last, TRUE AS took, 1 AS n FROM n WHERE k = 1 UNION ALL SELECT n.source, n.k, n.start, n.title, n.duration, CASE WHEN n.start - r.last >= 30000 AND r.n < 6 THEN n.start ELSE r.last END, n.start - r.last >= 30000 AND r.n < 6,
 r.n + CASE WHEN n.start - r.last >= 30000 AND r.n < 6 THEN 1 ELSE 0 END FROM r JOIN n ON n.source = r.source AND n.k = r.k + 1)
SELECT source, CAST(row_number() OVER w AS INTEGER) AS number, start, coalesce(lead(start) OVER w, duration) AS "end", title FROM r WHERE took AND start < duration WINDOW w AS (PARTITION BY source ORDER BY start)""")
def chapters(spark, sf_dir):
    s = segments(spark, sf_dir)
    lengths = s.groupBy("source").agg(F.max("end").alias("duration"))
    return planning.chapters(s.select("source", "start", F.col("speaker").alias("title")), lengths, ["source"], 30_000, 6)


@query("transition_bridges", r"""WITH s AS (SELECT conv_id AS source, turn AS id, CASE turn % 4 WHEN 0 THEN 'hook' WHEN 1 THEN 'pain' WHEN 2 THEN 'value' ELSE 'cta' END AS section, role AS route, [lower(w) FOR w IN regexp_extract_all(text, '\p{L}+')] AS kw FROM conversations),
p AS (SELECT *, lead(section) OVER w AS ns, lead(route) OVER w AS nr, lead(kw) OVER w AS nk FROM s WINDOW w AS (PARTITION BY source ORDER BY id)),
q AS (SELECT source, id, greatest(0, CASE WHEN section <> ns THEN 1.0 ELSE 0 END + CASE WHEN route <> nr THEN 1.0 ELSE 0 END + CASE WHEN NOT list_has_any(kw, nk) THEN 0.75 ELSE 0 END - CASE WHEN ns = 'cta' THEN 0.75 ELSE 0 END + CASE WHEN section = 'hook' AND ns IN ('pain', 'turn') THEN 0.5 ELSE 0 END)::DOUBLE AS need FROM p WHERE ns IS NOT NULL)
SELECT source, id, need, need >= 2.5 AND sum(CASE WHEN need >= 2.5 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY id) <= 2 AS bridge FROM q""")
def transition_bridges(spark, sf_dir):
    """With all words of each turn as its keywords, of any script."""
    c = table(spark, sf_dir, "conversations")
    section = F.element_at(F.array(*map(F.lit, ("hook", "pain", "value", "cta"))), (F.col("turn") % 4 + 1).cast("int"))
    words = F.transform(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), F.lower)
    shots = c.select(F.col("conv_id").alias("source"), F.col("turn").alias("id"), section.alias("section"), F.col("role").alias("route"), words.alias("keywords"))
    return planning.bridges(planning.transition_scores(shots, ["source"], ["id"]), ["source"], ["id"], 2.5, 2).select("source", "id", "need", "bridge")


_BOXES = """b AS (SELECT label, vec_id AS "at", CASE WHEN vec_id % 3 = 0 THEN 'face' ELSE 'car' END AS kind, 0.5 + (vec_id % 5) / 10.0::DOUBLE AS confidence, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS y1, embedding[1]::DOUBLE + 1 AS x2, embedding[2]::DOUBLE + 2 AS y2 FROM embeddings)"""


def _boxes(spark, sf_dir):
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("track"), F.col("vec_id").alias("at"), F.when(F.col("vec_id") % 3 == 0, "face").otherwise("car").alias("label"), (0.5 + (F.col("vec_id") % 5) / 10).alias("confidence"), x.alias("x1"), y.alias("y1"), (x + 1).alias("x2"), (y + 2).alias("y2"))


@query("weighted_focus", f"""WITH {_BOXES}, w AS (SELECT *, confidence * CASE kind WHEN 'face' THEN 2 ELSE 1 END AS w FROM b)
SELECT label AS track, sum((x1 + x2) / 2 * w) / sum(w) AS x, sum((y1 + y2) / 2 * w) / sum(w) AS y, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n FROM w GROUP BY label""")
def weighted_focus(spark, sf_dir):
    return planning.weighted_focus(_boxes(spark, sf_dir), ["track"], {"face": 2.0})


@query("track_summary", f"""WITH {_BOXES}, s AS (SELECT *, coalesce(sqrt(power((x1 + x2) / 2 - lag((x1 + x2) / 2) OVER w, 2) + power((y1 + y2) / 2 - lag((y1 + y2) / 2) OVER w, 2)), 0) AS step FROM b WINDOW w AS (PARTITION BY label ORDER BY "at"))
SELECT label AS track, min("at") AS first, max("at") AS last, count(*) AS boxes, avg(confidence) AS confidence, sum(step) AS path, CASE WHEN count(*) FILTER (kind = 'face') > count(*) FILTER (kind = 'car') THEN 'face' ELSE 'car' END AS label FROM s GROUP BY label""")
def track_summary(spark, sf_dir):
    return planning.track_summary(_boxes(spark, sf_dir), ["track"])


@query("clip_references", f"""WITH {SEGMENTS}, c AS (SELECT source, id AS number, id + CASE WHEN id % 3 = 0 THEN 100 ELSE 0 END AS segment_id, CASE WHEN id % 4 = 1 THEN 5 END AS cs FROM s)
SELECT c.source, c.number, CAST(c.segment_id AS VARCHAR) AS segment_id, coalesce(cs, s.start) AS start, s."end", CASE WHEN coalesce(cs, s.start) IS NULL OR s."end" IS NULL THEN 'segment_not_found' WHEN s."end" <= coalesce(cs, s.start) THEN 'empty_range' END AS problem
FROM c LEFT JOIN s ON c.source = s.source AND c.segment_id = s.id""")
def clip_references(spark, sf_dir):
    s = segments(spark, sf_dir)
    clips = s.select("source", F.col("id").alias("number"), (F.col("id") + F.when(F.col("id") % 3 == 0, 100).otherwise(0)).alias("segment_id"), F.when(F.col("id") % 4 == 1, F.lit(5).cast("long")).alias("start"), F.lit(None).cast("long").alias("end"))
    return planning.clip_references(clips, s, ["source"])


@query("expanded_ranges", "SELECT p_partkey, array_to_string(list_concat(CASE WHEN p_size <= 7 THEN range(p_size, 8) ELSE list_reverse(range(7, p_size + 1)) END, [p_partkey % 9]), ',') AS numbers FROM part")
def expanded_ranges(spark, sf_dir):
    text = F.concat(F.col("p_size").cast("string"), F.lit("-7, x, "), (F.col("p_partkey") % 9).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(selectors.expanded_ranges(text), ",").alias("numbers"))


@query("percentile_kinds", f"""WITH {UNITS}, v AS (SELECT source, list_sort(list(("end" - start)::DOUBLE)) AS v FROM u GROUP BY source) SELECT source, v[greatest(1, ceil(len(v) * 0.9)::INT)] AS nearest_rank, v[round_even((len(v) - 1) * 0.9::DOUBLE, 0)::INT + 1] AS rounded FROM v""")
def percentile_kinds(spark, sf_dir):
    v = units(spark, sf_dir).groupBy("source").agg(F.collect_list((F.col("end") - F.col("start")).cast("double")).alias("v"))
    return v.select("source", selectors.rank_percentile(F.col("v"), 0.9).alias("nearest_rank"), selectors.rounded_percentile(F.col("v"), 0.9).alias("rounded"))


@query("keyword_route", "SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'legal' WHEN contains(lower(text), 'stupid') OR contains(lower(text), 'scum') THEN 'flag' ELSE 'keep' END AS route FROM documents")
def keyword_route(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", selectors.keyword_route(F.col("text"), [("legal", ["license"]), ("flag", ["stupid", "scum"])], "keep").alias("route"))


@query("text_corrections", r"""SELECT doc_id, regexp_replace(regexp_replace(text, '\bthat\b', 'which', 'gi'), '\bof\b', 'from', 'gi') AS text FROM documents""")
def text_corrections(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", layout.corrected(F.col("text"), [("of", "from"), ("that", "which")]).alias("text"))
