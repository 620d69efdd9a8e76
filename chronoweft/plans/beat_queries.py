"""Queries over plans bound to beats and hashes of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.functions import geometry
from chronoweft.operators import beats
from chronoweft.plans.registry import query
from chronoweft.plans.views import table


@query("beat_plan", """WITH RECURSIVE b AS (SELECT user_id AS source, list_sort(list(DISTINCT event_id * 7919 % 61000) FILTER (event_id * 7919 % 61000 > 0 AND event_id * 7919 % 61000 < 40000 + user_id * 10)) AS beats, 40000 + user_id * 10 AS d FROM events GROUP BY user_id),
r AS (SELECT source, coalesce(beats, []) AS beats, d, 0 AS n, CAST(0 AS BIGINT) AS at_, CAST(0 AS BIGINT) AS before, NULL::INTEGER AS beat, NULL::VARCHAR AS how FROM b
 UNION ALL SELECT source, beats, d, n + 1, coalesce(best.b, least(at_ + 3000, d - 750)), at_, CAST(list_position(beats, best.b) AS INTEGER), CASE WHEN best.b IS NULL THEN 'max_segment' WHEN best.b = target THEN 'beats_per_cut' ELSE 'duration_guard' END
 FROM (SELECT *, list_min(list_transform(list_filter(future, lambda b: b - at_ BETWEEN 750 AND 3000 AND d - b >= 750), lambda b: {'far': abs(b - target), 'b': b})) AS best
  FROM (SELECT *, future[least(4, len(future))] AS target FROM (SELECT *, list_filter(beats, lambda b: b > at_) AS future FROM r WHERE d - at_ > 3000)))),
p AS (SELECT source, n, before AS start, at_ AS "end", CASE WHEN beat IS NULL THEN 'duration_guard' ELSE 'beat' END AS alignment, beat, how FROM r WHERE n > 0 UNION ALL SELECT source, max(n) + 1, max(at_), any_value(d), 'program_end', NULL, NULL FROM r GROUP BY source)
SELECT source, CAST(n AS INTEGER) AS number, start, "end", alignment, beat, how AS selected_by FROM p""")
def beat_plan(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    timelines = e.select(F.col("user_id").alias("source"), (F.col("user_id") * 10 + 40_000).alias("duration"))
    return beats.beat_plan(timelines, e.select(F.col("user_id").alias("source"), (F.col("event_id") * 7919 % 61_000).alias("at")), ["source"])


_PIXELS = "[CAST(floor(abs(embedding[i % 64 + 1]::DOUBLE) * 997) AS INTEGER) % 256 FOR i IN range(0, {0})]"


@query("frame_signatures", f"""WITH f AS (SELECT vec_id, {_PIXELS.format(216)} AS p FROM embeddings), g AS (SELECT vec_id, p, [(77 * p[3 * i + 1] + 150 * p[3 * i + 2] + 29 * p[3 * i + 3]) // 256 FOR i IN range(0, 72)] AS g FROM f),
h AS (SELECT vec_id, p, array_to_string([CASE WHEN g[i + 1] > g[i + 2] THEN '1' ELSE '0' END FOR i IN range(0, 72) IF i % 9 < 8], '') AS bits FROM g)
SELECT vec_id, lower(lpad(hex(CAST(CAST(bits AS BIT) AS BIGINT)), 16, '0')) AS dhash, round(list_sum([p[3 * i + 1] FOR i IN range(0, 72)]) / 72, 3) AS red, round(list_sum([p[3 * i + 3] FOR i IN range(0, 72)]) / 72, 3) AS blue FROM h""")
def frame_signatures(spark, sf_dir):
    pixels = F.transform(F.sequence(F.lit(0), F.lit(215)), lambda i: F.floor(F.abs(F.get("embedding", i % 64).cast("double")) * 997).cast("int") % 256)
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.array(pixels)).alias("p")).select("vec_id", geometry.frame_signature(F.col("p")).alias("s"))
    return e.select("vec_id", "s.dhash", F.col("s.mean_rgb")[0].alias("red"), F.col("s.mean_rgb")[2].alias("blue"))


@query("reduced_frames", f"""WITH f AS (SELECT vec_id, {_PIXELS.format(20 * 17 * 3)} AS p FROM embeddings), c AS (SELECT vec_id, p, unnest(range(0, 216)) AS i FROM f),
e AS (SELECT *, i % 3 AS c, (i // 3) % 9 * 20 // 9 AS l, ((i // 3) % 9 + 1) * 20 // 9 AS r, i // 27 * 17 // 8 AS t, (i // 27 + 1) * 17 // 8 AS b FROM c)
SELECT vec_id, CAST(i AS INTEGER) AS place, CAST(list_sum(list_transform(range(t * 20, b * 20), lambda q: CASE WHEN q % 20 >= l AND q % 20 < r THEN p[q * 3 + c + 1] ELSE 0 END)) // ((r - l) * (b - t)) AS INTEGER) AS value FROM e""")
def reduced_frames(spark, sf_dir):
    pixels = F.transform(F.sequence(F.lit(0), F.lit(20 * 17 * 3 - 1)), lambda i: F.floor(F.abs(F.get("embedding", i % 64).cast("double")) * 997).cast("int") % 256)
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.array(pixels)).alias("p"))
    return e.select("vec_id", F.posexplode(geometry.reduced_frame(F.col("p"), F.lit(20), F.lit(17))).alias("place", "value"))
