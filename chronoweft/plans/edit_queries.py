"""Queries over edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.operators import edits
from chronoweft.plans.registry import query
from chronoweft.plans.views import SEGMENTS, SPANS, UNITS, segments, spans, table, units


@query("matched_stories", """WITH s AS (SELECT CAST(c_custkey AS VARCHAR) AS story FROM customer WHERE c_custkey % 3 = 0), e AS (SELECT o_orderkey AS id, unnest(list_distinct([CAST(o_custkey AS VARCHAR), CAST(o_orderkey % 50 AS VARCHAR), trim(CASE WHEN o_orderkey % 4 = 0 THEN ' 9 ' ELSE '' END)])) AS key FROM orders),
h AS (SELECT id, count(*) AS n, min(story) AS story FROM e JOIN s ON key = story GROUP BY id) SELECT o_orderkey, CASE WHEN n = 1 THEN story END AS story FROM orders LEFT JOIN h ON o_orderkey = id""")
def matched_stories(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", (F.col("o_orderkey") % 50).alias("label"), F.when(F.col("o_orderkey") % 4 == 0, " 9 ").otherwise("").alias("stem"))
    stories = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("story_id"))
    return edits.matched_story(o, stories, ["o_custkey", "label", "stem"]).select(F.col("id").alias("o_orderkey"), "story")


_KEPT = f"""{SEGMENTS}, k AS (SELECT source, start + 100 AS start, "end" FROM s WHERE id % 3 <> 1 AND "end" > start + 100), l AS (SELECT source, max("end") AS duration FROM s GROUP BY source)"""


@query("kept_and_dropped", f"""WITH {_KEPT}, o AS (SELECT source, start, "end", coalesce(lag("end") OVER w, 0) AS f, 500 + coalesce(sum(("end" - start) / 1.25::DOUBLE) OVER (PARTITION BY source ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM k WINDOW w AS (PARTITION BY source ORDER BY start, "end"))
SELECT source, 'kept' AS kind, start, "end", p AS program_start, p + ("end" - start) / 1.25::DOUBLE AS program_end FROM o UNION ALL SELECT source, 'dropped', f, start, NULL, NULL FROM o WHERE start > f
UNION ALL SELECT l.source, 'dropped', coalesce(m, 0), duration, NULL, NULL FROM l LEFT JOIN (SELECT source, max("end") AS m FROM k GROUP BY source) USING (source) WHERE duration > coalesce(m, 0)""")
def kept_and_dropped(spark, sf_dir):
    s = segments(spark, sf_dir)
    kept = s.filter("id % 3 <> 1 AND end > start + 100").select("source", (F.col("start") + 100).alias("start"), "end")
    return edits.kept_and_dropped(kept, s.groupBy("source").agg(F.max("end").alias("duration")), ["source"], 1.25, 500)


@query("overlapping_keeps", f"""WITH {UNITS}, m AS (SELECT source, start, "end", max("end") OVER (PARTITION BY source ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u), p AS (SELECT source, start, "end", CASE WHEN start < 0 OR "end" <= start THEN 'bad_range' WHEN start < reach THEN 'overlaps' END AS problem FROM m) SELECT * FROM p WHERE problem IS NOT NULL""")
def overlapping_keeps(spark, sf_dir):
    return edits.overlapping_keeps(units(spark, sf_dir), ["source"])


_FRAMES = f"""{UNITS}, f AS (SELECT source, 'f' || id AS frame_id, start AS time FROM u WHERE speaker = 'view'), d AS (SELECT source, id, CASE WHEN id % 3 = 0 THEN 'f' || (id - 1) WHEN id % 3 = 1 THEN '' END AS frame_id, start AS time FROM u WHERE speaker <> 'view')"""


@query("detections_on_frames", f"""WITH {_FRAMES}, n AS (SELECT d.source, d.id, first(f.frame_id ORDER BY abs(f.time - d.time), f.time, f.frame_id) AS near FROM d JOIN f USING (source) GROUP BY d.source, d.id), t AS (SELECT d.source, d.id, coalesce(nullif(d.frame_id, ''), near) AS frame_id FROM d LEFT JOIN n USING (source, id))
SELECT t.* FROM t SEMI JOIN f ON t.source = f.source AND t.frame_id = f.frame_id""")
def detections_on_frames(spark, sf_dir):
    u = units(spark, sf_dir)
    frames = u.filter("speaker = 'view'").select("source", F.concat(F.lit("f"), F.col("id").cast("string")).alias("frame_id"), F.col("start").alias("time"))
    named = F.when(F.col("id") % 3 == 0, F.concat(F.lit("f"), (F.col("id") - 1).cast("string"))).when(F.col("id") % 3 == 1, "")
    detections = u.filter("speaker <> 'view'").select("source", "id", named.alias("frame_id"), F.col("start").alias("time"))
    return edits.on_frames(detections, frames, ["source"]).select("source", "id", "frame_id")


@query("scene_tags", """WITH d AS (SELECT label, CASE vec_id % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'vehicle' ELSE 'object' END AS tag FROM embeddings), t AS (SELECT label, bool_or(abs(embedding[1]) >= 0.22) AS large, bool_or(embedding[2] >= 0.12) AS moves FROM embeddings GROUP BY label)
SELECT label, tag, count(*) AS evidence FROM d GROUP BY label, tag UNION ALL SELECT label, 'dominant_subject', 1 FROM t WHERE large UNION ALL SELECT label, 'moving_subject', 1 FROM t WHERE moves
UNION ALL SELECT DISTINCT label + 1000, 'no_detected_objects', 0 FROM embeddings""")
def scene_tags(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    kind = F.when(F.col("vec_id") % 3 == 0, "person").when(F.col("vec_id") % 3 == 1, "vehicle").otherwise("object")
    scenes = e.select(F.explode(F.array("label", F.col("label") + 1000)).alias("label"))
    return edits.scene_tags(e.withColumn("category", kind), e.select("label", F.abs(F.col("embedding")[0]).alias("area"), F.col("embedding")[1].alias("moved")), scenes, ["label"])


_RHYTHM = f"""WITH {SPANS}, l AS (SELECT source, max("end") / 1000.0::DOUBLE AS duration FROM x GROUP BY source), c AS (SELECT DISTINCT source, duration, round(start / 1000.0::DOUBLE, 3) AS "at" FROM x JOIN l USING (source) WHERE start > 0 AND start / 1000.0::DOUBLE < duration),
t AS (SELECT source, count(*) AS cuts, count(*) FILTER (least(2, floor("at" / duration * 3)) = 0) AS opening, count(*) FILTER (least(2, floor("at" / duration * 3)) = 1) AS middle, count(*) FILTER (least(2, floor("at" / duration * 3)) = 2) AS closing FROM c GROUP BY source),
e AS (SELECT source, duration, "at" FROM c UNION ALL SELECT source, duration, 0.0 FROM l), h AS (SELECT source, duration, "at", coalesce(lead("at") OVER (PARTITION BY source ORDER BY "at"), duration) AS z FROM e), s0 AS (SELECT source, duration, "at", round(z - "at", 3) AS d FROM h WHERE z > "at"), s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY d) AS k, count(*) OVER (PARTITION BY source) AS n FROM s0),
f AS (SELECT source, duration, count(*) AS shots, round(avg(d), 3) AS mean, round(median(d), 3) AS median, round(min(d) FILTER (k >= ceil(n * 0.9::DOUBLE)), 3) AS p90, min(d) AS shortest, max(d) AS longest, round(stddev_pop(d) / avg(d), 3) AS variation, max_by(d, "at") AS final_hold FROM s GROUP BY ALL)
SELECT f.source, shots, mean, median, p90, round(final_hold / duration, 6) AS final_share, coalesce(round(opening / cuts, 6), 0)::DOUBLE AS opening_share, coalesce(round(middle / cuts, 6), 0)::DOUBLE AS middle_share, coalesce(round(closing / cuts, 6), 0)::DOUBLE AS closing_share, shortest, longest, variation, final_hold, coalesce(cuts, 0) AS cuts, coalesce(opening, 0) AS opening, coalesce(middle, 0) AS middle, coalesce(closing, 0) AS closing, round(coalesce(cuts, 0) * 60 / duration, 6) AS cuts_per_minute FROM f LEFT JOIN t USING (source)"""


@query("timeline_rhythm", _RHYTHM)
def timeline_rhythm(spark, sf_dir):
    x = spans(spark, sf_dir)
    return edits.timeline_rhythm(x.select("source", (F.col("start") / 1000).alias("at")), x.groupBy("source").agg((F.max("end") / 1000).alias("duration")), ["source"])


@query("cover_synergy", r"""WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN '' ELSE text END AS title, CASE turn % 4 WHEN 1 THEN substr(text, 1, 14) ELSE coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), 'x') END AS cover FROM conversations),
t AS (SELECT *, list_distinct([lower(x) FOR x IN regexp_extract_all(title, '[A-Za-z0-9]{2,}')]) AS a, list_distinct([lower(x) FOR x IN regexp_extract_all(cover, '[A-Za-z0-9]{2,}')]) AS b, regexp_replace(lower(title), '[^\p{L}\p{N}]+', '', 'g') AS na, regexp_replace(lower(cover), '[^\p{L}\p{N}]+', '', 'g') AS nb FROM p)
SELECT conv_id, turn, CASE WHEN title = '' THEN 'not_checked' WHEN na <> '' AND nb <> '' AND (contains(na, nb) OR contains(nb, na)) OR len(list_intersect(a, b)) / greatest(1, len(b))::DOUBLE >= 0.6 THEN 'warn' ELSE 'pass' END AS status FROM t""")
def cover_synergy(spark, sf_dir):
    from pyspark.sql import Window

    after = F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("x"))
    c = table(spark, sf_dir, "conversations").withColumn("title", F.when(F.col("turn") % 5 == 0, "").otherwise(F.col("text"))).withColumn("cover", F.when(F.col("turn") % 4 == 1, F.substring("text", 1, 14)).otherwise(after))
    return c.select("conv_id", "turn", edits.cover_synergy(F.col("title"), F.col("cover")).alias("status"))


@query("chapter_cards", """WITH t AS (SELECT conv_id, list(role || turn ORDER BY turn) AS titles, count(*)::INT AS n FROM conversations GROUP BY conv_id), c AS (SELECT conv_id, titles, least(n, 5) AS n, unnest(range(0, least(n, 5))) AS i FROM t)
SELECT conv_id, titles[i + 1] AS title, round(CASE WHEN conv_id % 2 = 0 AND n <= 4 THEN [1.5, 20.25, 40.125, 60.0][i + 1]::DOUBLE ELSE 3.0::DOUBLE + (90.0::DOUBLE - 3.0) / (n + 1) * (i + 1) END, 2) AS start FROM c""")
def chapter_cards(spark, sf_dir):
    titles = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], x["turn"].cast("string")))
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(titles.alias("titles"))
    marks = F.when(F.col("conv_id") % 2 == 0, F.array(*map(F.lit, (1.5, 20.25, 40.125, 60.0)))).otherwise(F.array().cast("array<double>"))
    return t.select("conv_id", F.inline(edits.chapter_cards(F.col("titles"), F.lit(90.0), marks)))


@query("audio_transitions", """WITH r AS (SELECT l_orderkey, l_linenumber % 4 AS after_clip, CASE l_linenumber % 3 WHEN 0 THEN 'J-Cut' WHEN 1 THEN 'l_cut' ELSE 'dissolve' END AS k, l_discount * 50 AS duration FROM lineitem),
p AS (SELECT l_orderkey, after_clip, replace(lower(k), '-', '_') AS kind, duration, CASE WHEN replace(lower(k), '-', '_') NOT IN ('j_cut', 'l_cut') THEN 'unknown_kind' WHEN after_clip NOT BETWEEN 1 AND 3 THEN 'no_such_boundary' WHEN duration NOT BETWEEN 0.05 AND 2.0 THEN 'bad_duration'
 WHEN row_number() OVER (PARTITION BY l_orderkey, after_clip ORDER BY replace(lower(k), '-', '_'), duration) > 1 THEN 'duplicate_boundary' END AS problem FROM r)
SELECT l_orderkey, after_clip, kind, problem, CASE WHEN problem IS NULL THEN CAST(row_number() OVER (PARTITION BY l_orderkey, problem IS NULL ORDER BY after_clip) AS INTEGER) END AS number FROM p""")
def audio_transitions(spark, sf_dir):
    n = F.col("l_linenumber")
    kind = F.when(n % 3 == 0, "J-Cut").when(n % 3 == 1, "l_cut").otherwise("dissolve")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (n % 4).alias("after_clip"), kind.alias("kind"), (F.col("l_discount") * 50).alias("duration"), F.lit(4).alias("clips"))
    return edits.transitions(rows, ["l_orderkey"]).select("l_orderkey", "after_clip", "kind", "problem", "number")


@query("transition_starts", f"""WITH RECURSIVE {SEGMENTS}, m AS (SELECT source, start, row_number() OVER (PARTITION BY source ORDER BY start, id) AS k FROM s WHERE start >= 4000 AND regexp_matches(lower(text), 'the|und')),
r AS (SELECT source, k, start, start AS last, TRUE AS took, 1 AS n FROM m WHERE k = 1 UNION ALL SELECT m.source, m.k, m.start, CASE WHEN m.start - r.last >= 4000 AND n < 5 THEN m.start ELSE r.last END, m.start - r.last >= 4000 AND n < 5, n + CASE WHEN m.start - r.last >= 4000 AND n < 5 THEN 1 ELSE 0 END FROM r JOIN m ON m.source = r.source AND m.k = r.k + 1)
SELECT source, start FROM r WHERE took""")
def transition_starts(spark, sf_dir):
    return edits.transition_starts(segments(spark, sf_dir), ["source"], ["the", "und"], 4000, 5)


@query("nearest_texts", f"""WITH {SEGMENTS}, p AS (SELECT source, id, (start + "end") // 2 + 137 AS "at" FROM s) SELECT p.source, p.id, first(s.text ORDER BY abs(s.start - "at"), s.start, s.id) AS text FROM p JOIN s USING (source) GROUP BY p.source, p.id""")
def nearest_texts(spark, sf_dir):
    s = segments(spark, sf_dir)
    points = s.select("source", "id", (F.floor((F.col("start") + F.col("end")) / 2) + 137).alias("at"))
    return edits.nearest_text(points, s, ["source"]).select("source", "id", "text")


@query("delivery_settings", """WITH t AS (SELECT p_partkey, CAST(floor(floor(p_size * 1.5::DOUBLE * 1024 * 1024) * 8 * 0.94::DOUBLE / (60 + p_partkey % 1000)) AS BIGINT) AS total, CASE WHEN p_size % 2 = 0 THEN 128000 ELSE 0 END AS audio FROM part) SELECT p_partkey, total, total - audio AS video, CASE WHEN total - audio < 150000 THEN 'too_small' END AS problem FROM t""")
def delivery_settings(spark, sf_dir):
    made = edits.delivery_settings(F.col("p_size") * 1.5, 60 + F.col("p_partkey") % 1000, F.when(F.col("p_size") % 2 == 0, 128_000).otherwise(0))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("m")).select("p_partkey", "m.*")


@query("overlay_ranges", """WITH r AS (SELECT p_partkey, unnest(CASE WHEN p_size % 3 = 0 THEN [{'s': p_size * 2.0::DOUBLE, 'e': p_size * 3.0::DOUBLE, 'p': 'left'}, {'s': NULL, 'e': p_size % 7 * 1.0::DOUBLE, 'p': ''}] ELSE [{'s': 1.0::DOUBLE, 'e': CASE WHEN p_size % 2 = 0 THEN 1.0::DOUBLE + p_size ELSE 9.5::DOUBLE END, 'p': 'right'}] END) AS r FROM part),
f AS (SELECT p_partkey, coalesce(r.s, 0) AS start, coalesce(r.e, r.s, 0) AS "end", coalesce(nullif(r.p, ''), 'right') AS position FROM r) SELECT * FROM f WHERE "end" > start""")
def overlay_ranges(spark, sf_dir):
    size = F.col("p_size")
    one = lambda s, e, p: F.struct(s.cast("double").alias("start"), e.cast("double").alias("end"), F.lit(p).alias("position"))
    given = F.when(size % 3 == 0, F.array(one(size * 2, size * 3, "left"), one(F.lit(None), size % 7, ""))).otherwise(F.array().cast("array<struct<start:double,end:double,position:string>>"))
    ranges = edits.overlay_ranges(given, F.lit(1.0), F.when(size % 2 == 1, 9.5), size.cast("double"), F.lit("right"))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(ranges))


@query("focus_events", """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 5 > 0 THEN vec_id::DOUBLE END AS s, CASE WHEN vec_id % 3 = 0 THEN vec_id + 2.5::DOUBLE END AS e, CASE WHEN vec_id % 4 = 0 THEN -1.0::DOUBLE END AS d, abs(embedding[1]::DOUBLE) * CASE WHEN vec_id % 2 = 0 THEN 1000 ELSE 1 END AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings),
t AS (SELECT *, coalesce(s, 0) AS a, coalesce(e, coalesce(s, 0) + coalesce(d, 1.2::DOUBLE)) AS b, x > 1 OR y > 1 AS px FROM e)
SELECT vec_id, a AS start, CASE WHEN b <= a THEN a + 1.2::DOUBLE ELSE b END AS "end", greatest(0.0, least(1.0, CASE WHEN px THEN x / 1920 ELSE x END)) AS x, greatest(0.0, least(1.0, CASE WHEN px THEN y / 1080 ELSE y END)) AS y, greatest(1.05::DOUBLE, least(4.0, z)) AS zoom FROM t""")
def focus_events(spark, sf_dir):
    i, v = F.col("vec_id"), lambda k: F.col("embedding")[k].cast("double")
    event = {"start": F.when(i % 5 > 0, i), "end": F.when(i % 3 == 0, i + 2.5), "duration": F.when(i % 4 == 0, -1), "x": F.abs(v(0)) * F.when(i % 2 == 0, 1000).otherwise(1), "y": v(1), "source_width": F.lit(1920), "source_height": F.lit(1080), "zoom": v(2) * 10}
    return table(spark, sf_dir, "embeddings").select("vec_id", edits.focus_event(event).alias("e")).select("vec_id", "e.*")


@query("adjustments", """WITH a AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0.05::DOUBLE ELSE embedding[1]::DOUBLE END AS b, 1 + embedding[2]::DOUBLE AS c, 1.1::DOUBLE AS s FROM embeddings), k AS (SELECT *, greatest(-0.3::DOUBLE, least(0.3::DOUBLE, b)) AS kb, greatest(0.5::DOUBLE, least(1.5::DOUBLE, c)) AS kc FROM a)
SELECT vec_id, kb AS brightness, kc AS contrast, s AS saturation, concat_ws(',', CASE WHEN kb <> b THEN 'brightness' END, CASE WHEN kc <> c THEN 'contrast' END) AS clamped FROM k""")
def adjustments(spark, sf_dir):
    v = lambda k: F.col("embedding")[k].cast("double")
    made = edits.adjusted({"brightness": 0.05, "contrast": 1.0, "saturation": 1.1}, {"brightness": F.when(F.col("vec_id") % 3 > 0, v(0)), "contrast": 1 + v(1)}, {"brightness": (-0.3, 0.3), "contrast": (0.5, 1.5), "saturation": (0.0, 2.0)})
    return table(spark, sf_dir, "embeddings").select("vec_id", made.alias("m")).select("vec_id", "m.brightness", "m.contrast", "m.saturation", F.array_join("m.clamped", ",").alias("clamped"))


@query("scene_medians", f"""WITH {UNITS}, c AS (SELECT source, id, start, "end" FROM u WHERE speaker = 'view' AND "end" > start), p AS (SELECT source, start AS time, (id % 100)::DOUBLE AS luma FROM u WHERE speaker <> 'view'),
i AS (SELECT c.source, c.id, luma, time BETWEEN start + e AND "end" - e AS inside FROM (SELECT *, least(2000000.0::DOUBLE, greatest(0.0, ("end" - start) / 2.0::DOUBLE - 10)) AS e FROM c) c JOIN p ON c.source = p.source AND time >= start AND time < "end"), m AS (SELECT *, bool_or(inside) OVER (PARTITION BY source, id) AS anyone FROM i)
SELECT source, id, count(*) AS n, bool_and(NOT inside) AS near_edge, median(luma) AS luma FROM m WHERE inside OR NOT anyone GROUP BY source, id""")
def scene_medians(spark, sf_dir):
    u = units(spark, sf_dir)
    samples = u.filter("speaker <> 'view'").select("source", F.col("start").alias("time"), (F.col("id") % 100).cast("double").alias("luma"))
    return edits.scene_medians(samples, u.filter("speaker = 'view' AND end > start"), ["source"], ["luma"], 2_000_000, 36_000_000)


@query("keyed_translations", """WITH i AS (SELECT p_partkey AS place, CASE WHEN p_size % 3 = 0 THEN '  ' ELSE p_name END AS a, p_type AS b, [CAST(p_partkey AS VARCHAR), 'cue' || p_size, CASE WHEN p_size % 2 = 0 THEN '' ELSE 's' || p_brand END] AS keys FROM part), k AS (SELECT place, coalesce(nullif(trim(regexp_replace(a, '\\s+', ' ', 'g')), ''), b) AS text, unnest(keys) AS key FROM i)
SELECT key, max_by(text, place) AS text FROM k WHERE key <> '' GROUP BY key""")
def keyed_translations(spark, sf_dir):
    size = F.col("p_size")
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), F.when(size % 3 == 0, "  ").otherwise(F.col("p_name")).alias("target_text"), F.col("p_type").alias("text"), "p_partkey", F.concat(F.lit("cue"), size.cast("string")).alias("cue_id"), F.when(size % 2 == 0, "").otherwise(F.concat(F.lit("s"), "p_brand")).alias("source_id"))
    return edits.keyed_translations(items, ["p_partkey", "cue_id", "source_id"], ["target_text", "text"])


@query("rhythm_deltas", f"""WITH m AS ({_RHYTHM}), p AS (SELECT a.source, b.source AS other, unnest(['cuts_per_minute', 'median', 'final_hold']) AS metric, unnest([abs(a.cuts_per_minute - b.cuts_per_minute), abs(a.median - b.median), abs(a.final_hold - b.final_hold)]) AS d, unnest([1.5, 4.0, 8.0]) AS t FROM m a JOIN m b ON b.source = a.source + 1)
SELECT source, other, metric, round(d, 6) AS delta, d <= t AS within FROM p""")
def rhythm_deltas(spark, sf_dir):
    """Each supplier's timeline against that of the next supplier."""
    from chronoweft.operators import graph, scheduling

    metrics = graph.cut_lineage(timeline_rhythm(spark, sf_dir), "rhythm")  # read three times
    pairs = metrics.select("source", (F.col("source") + 1).alias("other"))
    return scheduling.rhythm_deltas(metrics, ["source"], pairs, {"cuts_per_minute": 1.5, "median": 4.0, "final_hold": 8.0})
