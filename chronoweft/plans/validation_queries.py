"""Queries over checks of claims, references, encodings, patches and measurements, and over command strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.operators import validation
from chronoweft.plans.registry import query
from chronoweft.plans.views import SEGMENTS, segments, table
from chronoweft.sources import commands

_M = "m AS (SELECT p_partkey AS id, -10.0 - p_size::DOUBLE / 4 AS integrated, -3.0 + (p_partkey % 4) AS peak, (p_partkey % 20)::DOUBLE AS range, (p_partkey % 7)::DOUBLE AS silence FROM part)"


@query("loudness_findings", f"""WITH {_M} SELECT id, 'loudness' AS kind, CASE WHEN abs(integrated + 16) > 3 THEN 'block' ELSE 'warn' END AS severity, integrated::DOUBLE AS value, -16::DOUBLE AS "limit" FROM m WHERE abs(integrated + 16) > 1.5
 UNION ALL SELECT id, 'true_peak', 'block', peak, -1 FROM m WHERE peak > -1 UNION ALL SELECT id, 'loudness_range', 'warn', range, 15 FROM m WHERE range > 15 UNION ALL SELECT id, 'long_silence', 'warn', silence, 5 FROM m WHERE silence > 5""")
def loudness_findings(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), (-10.0 - F.col("p_size") / 4).alias("integrated"), (-3.0 + k % 4).alias("peak"), (k % 20).cast("double").alias("range"), (k % 7).cast("double").alias("longest_silence"))
    return validation.measured(rows, ["id"], -16.0, 1.5, -1.0, 15.0, 5.0)


@query("claim_evidence", """WITH c AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN ' ' ELSE 'x' END AS t, CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN url ELSE 'ftp:' || url END AS u, CASE WHEN page_id % 2 = 0 THEN 'primary' END AS k FROM pages)
SELECT page_id, 'no_text' AS kind, 'block' AS severity, NULL::DOUBLE AS value, NULL::DOUBLE AS "limit" FROM c WHERE trim(t) = '' UNION ALL SELECT page_id, 'no_source', 'block', NULL, NULL FROM c WHERE u = ''
 UNION ALL SELECT page_id, 'bad_url', 'block', NULL, NULL FROM c WHERE u <> '' AND NOT regexp_matches(u, '^https?://[^/]+') UNION ALL SELECT page_id, 'not_primary', 'warn', NULL, NULL FROM c WHERE k IS DISTINCT FROM 'primary'""")
def claim_evidence(spark, sf_dir):
    k = F.col("page_id")
    url = F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("url")).otherwise(F.concat(F.lit("ftp:"), F.col("url")))
    claims = table(spark, sf_dir, "pages").select("page_id", F.when(k % 5 == 0, " ").otherwise("x").alias("text"), url.alias("source_url"), F.lit(None).cast("string").alias("source_file"), F.when(k % 2 == 0, "primary").alias("source_type"))
    return validation.evidenced(claims, ["page_id"], False, True)


@query("reference_frames", """WITH f AS (SELECT p_partkey AS id, 600 + p_size * 20 AS w, 1080 AS h, p_partkey % 6 = 0 AS a FROM part), r AS (SELECT *, w / h::DOUBLE AS r, w > h AS turned FROM f)
SELECT id, 'orientation' AS kind, 'block' AS severity, r AS value, 0.5625::DOUBLE AS "limit" FROM r WHERE turned UNION ALL SELECT id, 'aspect', 'warn', r, 0.5625 FROM r WHERE NOT turned AND abs(r / 0.5625 - 1) > 0.1
 UNION ALL SELECT id, 'too_small', 'warn', least(w, h), 720 FROM r WHERE least(w, h) < 720 UNION ALL SELECT id, 'alpha', 'warn', NULL, NULL FROM r WHERE a""")
def reference_frames(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (600 + F.col("p_size") * 20).alias("width"), F.lit(1080).alias("height"), (F.col("p_partkey") % 6 == 0).alias("alpha"))
    return validation.framed(rows, ["id"], 0.5625, 0.1, 720)


@query("patch_checks", """WITH p AS (SELECT conv_id AS source, turn AS patch_id, turn + CASE WHEN turn % 5 = 4 THEN 50 ELSE 0 END AS segment_id, 3 AS start, CASE WHEN turn % 2 = 0 THEN substr(text, 4, 5) ELSE substr(text, 5, 5) END AS before, CASE WHEN turn % 3 = 0 THEN substr(text, 4, 5) ELSE 'new 5 text' END AS after FROM conversations),
j AS (SELECT p.*, c.text FROM p LEFT JOIN conversations c ON c.conv_id = p.source AND c.turn = p.segment_id)
SELECT source, patch_id, 'unknown_segment' AS kind, 'block' AS severity, NULL::DOUBLE AS value, NULL::DOUBLE AS "limit" FROM j WHERE text IS NULL UNION ALL SELECT source, patch_id, 'span_differs', 'block', start, NULL FROM j WHERE text IS NOT NULL AND substr(text, 4, length(before)) <> before
 UNION ALL SELECT source, patch_id, 'no_change', 'block', NULL, NULL FROM j WHERE before = after UNION ALL SELECT source, patch_id, 'numbers_changed', 'block', NULL, NULL FROM j WHERE regexp_extract_all(before, '\\d+(?:[.,]\\d+)*') <> regexp_extract_all(after, '\\d+(?:[.,]\\d+)*')
 UNION ALL SELECT source, patch_id, 'too_much_changed', 'warn', length(after), 4 FROM j WHERE abs(length(after) - length(before)) > 4""")
def patch_checks(spark, sf_dir):
    s, t = segments(spark, sf_dir), F.col("id")
    before = F.when(t % 2 == 0, F.substring("text", 4, 5)).otherwise(F.substring("text", 5, 5))
    patches = s.select("source", t.alias("patch_id"), (t + F.when(t % 5 == 4, 50).otherwise(0)).alias("segment_id"), F.lit(3).alias("start"), before.alias("before"), F.when(t % 3 == 0, F.substring("text", 4, 5)).otherwise("new 5 text").alias("after"))
    return validation.patched(patches, s, ["source"], 4)


@query("review_scores", """WITH r AS (SELECT o_orderkey AS id, (o_orderkey % 101)::DOUBLE AS a, (o_orderkey % 97 + 10)::DOUBLE AS b FROM orders), s AS (SELECT id, CASE WHEN a BETWEEN 0 AND 100 AND b BETWEEN 0 AND 100 THEN (a * 0.7 + b * 0.3) / 1.0 END AS score FROM r)
SELECT id, score::DOUBLE AS score, CASE WHEN score IS NULL THEN 'invalid' WHEN score >= 80 THEN 'ready' WHEN score >= 65 THEN 'review' ELSE 'blocked' END AS verdict FROM s""")
def review_scores(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), (k % 101).cast("double").alias("a"), (k % 97 + 10).cast("double").alias("b"))
    return validation.scored(rows, {"a": 0.7, "b": 0.3}).select("id", "score", "verdict")


@query("trim_filters", f"""WITH {SEGMENTS}, n AS (SELECT source, id, start / 1000::DOUBLE AS a, "end" / 1000::DOUBLE AS b FROM s)
SELECT source, string_agg(printf('[0:v]trim=%.3f:%.3f,setpts=PTS-STARTPTS[v%d];[0:a]atrim=%.3f:%.3f,asetpts=PTS-STARTPTS[a%d]', a, b, id, a, b, id), ';' ORDER BY id) || ';' || string_agg(printf('[v%d][a%d]', id, id), '' ORDER BY id) || printf('concat=n=%d:v=1:a=1[v][a]', count(*)) AS text FROM n GROUP BY source""")
def trim_filters(spark, sf_dir):
    return commands.trim_filters(segments(spark, sf_dir).select("source", F.col("id").alias("number"), "start", "end"), ["source"])


@query("grade_filter", """SELECT p_partkey, printf('eq=brightness=%.3f:contrast=%.3f:saturation=%.3f', greatest(-0.3, least(0.3, p_size / 100.0::DOUBLE - 0.25)), greatest(0.5, least(1.5, p_size / 25.0::DOUBLE)), greatest(0.0, least(2.0, p_size / 20.0::DOUBLE))) AS filter FROM part""")
def grade_filter(spark, sf_dir):
    z = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", commands.grade_filter(z / 100 - 0.25, z / 25, z / 20).alias("filter"))
