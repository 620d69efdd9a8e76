"""Queries over cues and plans drawn from what is said."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.operators import scheduling, signal
from chronoweft.plans.registry import query
from chronoweft.plans.views import SEGMENTS, UNITS, segments, table, units


def _taken(key: str, gap: int, most: int = 10**9) -> str:
    """Recursive part: r has the rows of m(key, k, start, ...) with `took`, where each taken one is gap or more after the last."""
    go = f"m.start - r.last >= {gap} AND n < {most}"
    return f"""r AS (SELECT m.*, start AS last, TRUE AS took, 1 AS n FROM m WHERE k = 1 UNION ALL SELECT m.*, CASE WHEN {go} THEN m.start ELSE r.last END, {go}, n + CASE WHEN {go} THEN 1 ELSE 0 END FROM r JOIN m ON {' AND '.join(f'm.{c} = r.{c}' for c in key.split(','))} AND m.k = r.k + 1)"""


_FELT = f"""{SEGMENTS}, f AS (SELECT *, CASE WHEN regexp_matches(lower(text), 'the|a') THEN 'glad' WHEN regexp_matches(lower(text), 'und|que') THEN 'sad' END AS feeling FROM s), m AS (SELECT source, start, id, feeling, row_number() OVER (PARTITION BY source ORDER BY start, id) AS k FROM f WHERE feeling IS NOT NULL)"""


@query("sticker_cues", f"""WITH RECURSIVE {_FELT}, {_taken('source', 8000)} SELECT source, start, id, feeling, CAST((row_number() OVER (PARTITION BY source ORDER BY start, id) - 1) % CASE feeling WHEN 'glad' THEN 3 ELSE 2 END AS INTEGER) AS sticker FROM r WHERE took""")
def sticker_cues(spark, sf_dir):
    return scheduling.stickers(segments(spark, sf_dir), ["source"], {"glad": ["the", "a"], "sad": ["und", "que"]}, {"glad": 3, "sad": 2}, 8000)


@query("sound_cues", f"""WITH RECURSIVE {_FELT}, {_taken('source', 3000, 4)} SELECT source, start, id, feeling AS sound FROM r WHERE took""")
def sound_cues(spark, sf_dir):
    return scheduling.sounds(segments(spark, sf_dir), ["source"], {"glad": ["the", "a"], "sad": ["und", "que"]}, 3000, 4)


@query("speaker_badges", f"""WITH RECURSIVE {UNITS}, v AS (SELECT source, CASE WHEN speaker = 'view' THEN 'unknown' ELSE speaker END AS speaker, start, "end" FROM u), f AS (SELECT *, lag(speaker) OVER w IS NOT DISTINCT FROM speaker AS same FROM v WHERE "end" > start OR speaker = 'unknown' WINDOW w AS (PARTITION BY source ORDER BY start, "end", speaker)),
g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY start, "end", speaker ROWS UNBOUNDED PRECEDING) AS run FROM f),
m AS (SELECT source, run, speaker, start, "end", row_number() OVER (PARTITION BY source, run ORDER BY start, "end") AS k FROM g WHERE speaker <> 'unknown'), {_taken('source,run', 86400000)} SELECT source, speaker, start, start + least(5000000, greatest(600, "end" - start)) AS "end" FROM r WHERE took""")
def speaker_badges(spark, sf_dir):
    rows = units(spark, sf_dir).withColumn("speaker", F.when(F.col("speaker") == "view", "unknown").otherwise(F.col("speaker")))
    return scheduling.badges(rows, ["source"], 5_000_000, 86_400_000)


@query("opportunities", f"""WITH {SEGMENTS}, t AS (SELECT source, id, start, CASE WHEN regexp_matches(lower(text), 'the') THEN 'chart' WHEN regexp_matches(lower(text), 'e') THEN 'photo' END AS template, CAST(round(start / 1000.0::DOUBLE) AS BIGINT) AS second FROM s) SELECT source, id, template, second FROM t WHERE template IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, template, second ORDER BY start, id) = 1""")
def opportunities(spark, sf_dir):
    return scheduling.opportunities(segments(spark, sf_dir), ["source"], {"chart": ["the"], "photo": ["e"]})


@query("directed_segments", """WITH d AS (SELECT conv_id AS source, turn + CASE WHEN turn % 7 = 6 THEN 500 ELSE 0 END AS id, CASE turn % 2 WHEN 0 THEN 'keep' ELSE 'drop' END AS action FROM conversations WHERE turn % 5 > 0 UNION ALL SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'keep' ELSE 'drop' END FROM conversations WHERE turn % 4 = 1), t AS (SELECT source, id, min(action) AS action, count(DISTINCT action) AS kinds, count(*) AS n FROM d GROUP BY ALL),
s AS (SELECT conv_id AS source, turn AS id FROM conversations) SELECT coalesce(s.source, t.source) AS source, coalesce(s.id, t.id) AS id, CASE WHEN kinds = 1 THEN action END AS action, CASE WHEN s.id IS NULL THEN 'missing_segment' WHEN kinds > 1 THEN 'conflict' WHEN n > 1 THEN 'duplicate' WHEN n IS NULL THEN 'unreviewed' END AS problem FROM s FULL JOIN t ON s.source = t.source AND s.id = t.id""")
def directed_segments(spark, sf_dir):
    c, t = table(spark, sf_dir, "conversations"), F.col("turn")
    one = c.filter(t % 5 > 0).select(F.col("conv_id").alias("source"), (t + F.when(t % 7 == 6, 500).otherwise(0)).alias("id"), F.when(t % 2 == 0, "keep").otherwise("drop").alias("action"))
    two = c.filter(t % 4 == 1).select(F.col("conv_id").alias("source"), t.alias("id"), F.when(t % 3 == 0, "keep").otherwise("drop").alias("action"))
    return scheduling.directed(c.select(F.col("conv_id").alias("source"), t.alias("id")), one.unionByName(two), ["source"])


_CUES = f"""{UNITS}, a AS (SELECT source, speaker AS kind, start, "end" FROM u WHERE id % 2 = 0), b AS (SELECT DISTINCT source, speaker AS kind, start, "end" + id % 3 AS "end" FROM u WHERE id % 3 = 0)"""


@query("merged_cues", f"""WITH {_CUES} SELECT source, kind, start, "end", 'config' AS origin FROM a UNION ALL SELECT b.*, 'plan' FROM b ANTI JOIN a ON a.source = b.source AND a.kind = b.kind AND a.start = b.start""")
def merged_cues(spark, sf_dir):
    u = units(spark, sf_dir).withColumn("kind", F.col("speaker"))
    return scheduling.merged_cues(u.filter("id % 2 = 0"), u.filter("id % 3 = 0").withColumn("end", F.col("end") + F.col("id") % 3), ["source"])


@query("stock_plan", """WITH p AS (SELECT p_partkey, p_type AS term, unnest(['pexels', 'pixabay', 'local']) AS provider FROM part) SELECT p_partkey, term, provider, 4 AS wanted, 3 * 4 * 5.0 >= 55 AS enough FROM p""")
def stock_plan(spark, sf_dir):
    return scheduling.stock_plan(table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("term")), ["p_partkey"], ["pexels", "pixabay", "local"], 4, 55)


@query("consistent_offsets", """WITH o AS (SELECT label AS shoot, vec_id AS angle, round(embedding[1]::DOUBLE, 3) AS o FROM embeddings), m AS (SELECT label AS shoot, vec_id AS l, vec_id + (SELECT 10) AS r, round(embedding[2]::DOUBLE, 3) AS direct FROM embeddings)
SELECT m.shoot, l AS "left", r AS "right", round(b.o - a.o, 4) AS implied, round(direct, 4) AS direct, round(abs(direct - (b.o - a.o)), 4) AS divergence, abs(direct - (b.o - a.o)) <= 0.1 AS consistent FROM m JOIN o a ON a.shoot = m.shoot AND a.angle = l JOIN o b ON b.shoot = m.shoot AND b.angle = r""")
def consistent_offsets(spark, sf_dir):
    e, v = table(spark, sf_dir, "embeddings"), lambda k: F.round(F.col("embedding")[k].cast("double"), 3)
    offsets = e.select(F.col("label").alias("shoot"), F.col("vec_id").alias("angle"), v(0).alias("offset"))
    measured = e.select(F.col("label").alias("shoot"), F.col("vec_id").alias("left"), (F.col("vec_id") + 10).alias("right"), v(1).alias("direct"))
    return scheduling.consistent_offsets(offsets, measured, ["shoot"], 0.1)


@query("sync_status", """WITH a AS (SELECT vec_id, CASE WHEN vec_id % 5 > 0 THEN abs(embedding[1]::DOUBLE) * 4 END AS c, abs(embedding[2]::DOUBLE) AS m, embedding[3]::DOUBLE * 100 AS o, vec_id % 7 = 0 AS given FROM embeddings), w AS (SELECT *, CASE WHEN given THEN '' ELSE concat_ws(',', CASE WHEN c IS NULL THEN 'not_measured' END, CASE WHEN c < 0.35 THEN 'low_confidence' END, CASE WHEN m < 0.05 THEN 'ambiguous' END, CASE WHEN abs(o) >= 15 THEN 'at_search_limit' END) END AS warnings FROM a)
SELECT vec_id, CASE WHEN given OR warnings = '' THEN 'ready' WHEN c IS NULL OR c < 0.35 THEN 'blocked' ELSE 'review' END AS status, warnings FROM w""")
def sync_status(spark, sf_dir):
    i, v = F.col("vec_id"), lambda k: F.col("embedding")[k].cast("double")
    told = scheduling.sync_status(F.when(i % 5 > 0, F.abs(v(0)) * 4), F.abs(v(1)), v(2) * 100, i % 7 == 0, 0.35, 15)
    return table(spark, sf_dir, "embeddings").select("vec_id", told.alias("s")).select("vec_id", "s.status", "s.warnings")


@query("preflight", """WITH f AS (SELECT l_orderkey, CASE WHEN l_quantity > 45 THEN 'block' WHEN l_quantity > 40 THEN 'warn' END AS severity, l_returnflag AS code FROM lineitem), c AS (SELECT l_orderkey, count(*) FILTER (severity = 'block') AS blocking, count(*) FILTER (severity = 'warn') AS warnings, min(CASE WHEN severity = 'block' THEN code END) AS first FROM f WHERE severity IS NOT NULL GROUP BY l_orderkey)
SELECT o_orderkey AS l_orderkey, coalesce(blocking, 0) AS blocking, coalesce(warnings, 0) AS warnings, first, CASE WHEN blocking > 0 THEN 'blocked' WHEN warnings > 0 THEN 'review' ELSE 'ready' END AS status FROM orders LEFT JOIN c ON o_orderkey = l_orderkey""")
def preflight(spark, sf_dir):
    severity = F.when(F.col("l_quantity") > 45, "block").when(F.col("l_quantity") > 40, "warn")
    findings = table(spark, sf_dir, "lineitem").select("l_orderkey", severity.alias("severity"), F.col("l_returnflag").alias("code")).filter("severity IS NOT NULL")
    return scheduling.preflight(findings, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"])


@query("probe_times", f"""WITH {UNITS}, d AS (SELECT id, ("end" - start) / 100000.0::DOUBLE AS n FROM u), p AS (SELECT id, n - 6 AS room FROM d) SELECT id, CAST(CASE WHEN room >= 24 THEN 5 WHEN room >= 0 THEN 1 ELSE 0 END AS INTEGER) AS probes, CASE WHEN room >= 24 THEN round(1.0::DOUBLE + room * 4 / 4, 3) WHEN room >= 0 THEN round(1.0::DOUBLE + room / 2, 3) END AS last FROM p""")
def probe_times(spark, sf_dir):
    n = (F.col("end") - F.col("start")) / 100_000
    times = scheduling.probe_times(F.lit(1.0), n + 1.0, 5, 6.0)
    return units(spark, sf_dir).select("id", times.alias("t")).select("id", F.size("t").alias("probes"), F.try_element_at("t", F.lit(-1)).alias("last"))


@query("numbers_at", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size ELSE 0 END AS blocking FROM part""")
def numbers_at(spark, sf_dir):
    size = F.col("p_size")
    json = F.when(size % 3 == 0, F.concat(F.lit('{"summary":{"blocking":'), size.cast("string"), F.lit("}}"))).when(size % 3 == 1, '{"summary":{"blocking":"many"}}').otherwise("no json")
    return table(spark, sf_dir, "part").select("p_partkey", scheduling.whole_number_at(json, "$.summary.blocking").alias("blocking"))


@query("color_jumps", f"""WITH {UNITS}, p AS (SELECT source, id, start, (id % 17)::DOUBLE AS a, (id % 5)::DOUBLE AS b FROM u), j AS (SELECT source, id, sqrt(power(a - lag(a) OVER w, 2) + power(b - lag(b) OVER w, 2)) AS jump FROM p WINDOW w AS (PARTITION BY source ORDER BY start, id)) SELECT * FROM j WHERE jump > 9""")
def color_jumps(spark, sf_dir):
    rows = units(spark, sf_dir).select("source", "id", "start", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    return signal.changes(rows, ["source"], ["start", "id"], ["a", "b"], 9).select("source", "id", "jump")
