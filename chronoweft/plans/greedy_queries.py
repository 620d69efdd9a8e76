"""Queries over order-dependent choices. Their SQL uses recursive tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.functions.text import without_fillers
from chronoweft.operators import greedy
from chronoweft.plans.registry import query
from chronoweft.plans.views import SEGMENTS, SPANS, UNITS, segments, spans, table, units

_DAY = 86_400_000


@query("cooldown", f"""WITH RECURSIVE {UNITS}, n AS (SELECT source, id, start, row_number() OVER (PARTITION BY source ORDER BY start, id) AS k FROM u),
r AS (SELECT source, k, id, start, start AS last, TRUE AS took, 1 AS n FROM n WHERE k = 1
 UNION ALL SELECT n.source, n.k, n.id, n.start, CASE WHEN n.start - r.last >= {_DAY} AND r.n < 8 THEN n.start ELSE r.last END, n.start - r.last >= {_DAY} AND r.n < 8, r.n + CASE WHEN n.start - r.last >= {_DAY} AND r.n < 8 THEN 1 ELSE 0 END
 FROM r JOIN n ON n.source = r.source AND n.k = r.k + 1)
SELECT source, id, start FROM r WHERE took""")
def cooldown(spark, sf_dir):
    rows = units(spark, sf_dir).select("source", "id", "start")
    return greedy.cooldown(rows, ["source"], "start", _DAY, ["id"], 8)


@query("spaced_boundaries", f"""WITH RECURSIVE {SPANS}, p AS (SELECT DISTINCT source, start AS t FROM x WHERE flag = 'R' AND start > 0 AND start < 2700000), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t) AS k FROM p),
r AS (SELECT source, k, t, CASE WHEN t >= 5000 THEN t ELSE 0 END AS last, t >= 5000 AS took FROM n WHERE k = 1
 UNION ALL SELECT n.source, n.k, n.t, CASE WHEN n.t - r.last >= 5000 THEN n.t ELSE r.last END, n.t - r.last >= 5000 FROM r JOIN n ON n.source = r.source AND n.k = r.k + 1),
e AS (SELECT source, t, max(t) OVER (PARTITION BY source) AS final FROM r WHERE took) SELECT source, t AS "at" FROM e WHERE NOT (t = final AND 2700000 - t < 5000)""")
def spaced_boundaries(spark, sf_dir):
    rows = spans(spark, sf_dir)
    lengths = rows.select("source").distinct().withColumn("duration", F.lit(2_700_000).cast("long"))
    return greedy.spaced(rows.filter("flag = 'R'").select("source", F.col("start").alias("at")).distinct(), lengths, ["source"], 5000)


@query("packed_units", f"""WITH RECURSIVE {SEGMENTS}, n AS (SELECT source, id, length(text) AS z, row_number() OVER (PARTITION BY source ORDER BY id) AS k FROM s),
r AS (SELECT source, k, id, z AS held, 0 AS pack FROM n WHERE k = 1 UNION ALL SELECT n.source, n.k, n.id, CASE WHEN r.held > 0 AND r.held + n.z > 1500 THEN n.z ELSE r.held + n.z END, r.pack + CASE WHEN r.held > 0 AND r.held + n.z > 1500 THEN 1 ELSE 0 END
 FROM r JOIN n ON n.source = r.source AND n.k = r.k + 1) SELECT source, id, pack FROM r""")
def packed_units(spark, sf_dir):
    return greedy.packed(segments(spark, sf_dir).select("source", "id", "text"), ["source"], ["id"], F.length("text"), 1500).select("source", "id", "pack")


@query("segment_windows", f"""WITH {SEGMENTS}, n AS (SELECT source, start, "end", CAST(row_number() OVER (PARTITION BY source ORDER BY start, "end") AS INTEGER) AS k FROM s)
SELECT a.source, a.k AS first, b.k AS last, a.start, b."end" FROM n a JOIN n b ON a.source = b.source AND b.k >= a.k WHERE b."end" - a.start BETWEEN 20000 AND 90000""")
def segment_windows(spark, sf_dir):
    return greedy.windows(segments(spark, sf_dir), ["source"], 20_000, 90_000)


_NMS = f"""{UNITS}, n AS (SELECT source, id, start, "end", "end" - start AS score, row_number() OVER (PARTITION BY source ORDER BY "end" - start DESC, start, id) AS k FROM u)"""


@query("overlap_suppression", f"""WITH RECURSIVE {_NMS}, r AS (SELECT source, k, id, [id] AS kept, [start] AS ss, ["end"] AS es, TRUE AS took FROM n WHERE k = 1
 UNION ALL SELECT source, k, id, CASE WHEN ok THEN list_append(kept, id) ELSE kept END, CASE WHEN ok THEN list_append(ss, start) ELSE ss END, CASE WHEN ok THEN list_append(es, "end") ELSE es END, ok
 FROM (SELECT n.source, n.k, n.id, n.start, n."end", r.kept, r.ss, r.es, len([1 FOR i IN range(1, len(r.ss) + 1) IF greatest(0, least(n."end", r.es[i]) - greatest(n.start, r.ss[i])) > 0.5 * greatest(least(n."end" - n.start, r.es[i] - r.ss[i]), 1e-9)]) = 0 AS ok
  FROM r JOIN n ON n.source = r.source AND n.k = r.k + 1))
SELECT source, id FROM r WHERE took""")
def overlap_suppression(spark, sf_dir):
    rows = units(spark, sf_dir).select("source", "id", "start", "end", (F.col("end") - F.col("start")).alias("score"))
    return greedy.suppressed(rows, ["source"], 0.5).select("source", "id")


@query("emphasis_schedule", f"""WITH RECURSIVE {_NMS}, r AS (SELECT source, k, id, [start] AS ss, TRUE AS took FROM n WHERE k = 1
 UNION ALL SELECT source, k, id, CASE WHEN ok THEN list_append(ss, start) ELSE ss END, ok FROM (SELECT n.source, n.k, n.id, n.start, r.ss, len(r.ss) < 12 AND len([1 FOR x IN r.ss IF abs(x - n.start) < {_DAY}]) = 0 AS ok FROM r JOIN n ON n.source = r.source AND n.k = r.k + 1))
SELECT source, id FROM r WHERE took""")
def emphasis_schedule(spark, sf_dir):
    rows = units(spark, sf_dir).select("source", "id", F.col("start").alias("at"), (F.col("end") - F.col("start")).alias("score"))
    return greedy.emphasis(rows, ["source"], _DAY, 12).select("source", "id")


@query("phrase_packing", f"""WITH RECURSIVE {SEGMENTS}, n AS (SELECT source, id, start, "end", speaker, length(text) AS z, row_number() OVER (PARTITION BY source ORDER BY start, "end", id) AS k FROM s),
r AS (SELECT source, k, id, "end", speaker, z AS chars, 1 AS phrase FROM n WHERE k = 1
 UNION ALL SELECT source, k, id, "end", speaker, CASE WHEN br THEN z ELSE chars + z + CASE WHEN chars > 0 THEN 1 ELSE 0 END END, phrase + CASE WHEN br THEN 1 ELSE 0 END
 FROM (SELECT n.source, n.k, n.id, n."end", n.speaker, n.z, r.chars, r.phrase, n.start - r."end" >= 500 OR n.speaker <> r.speaker OR r.chars + n.z + 1 > 900 AS br FROM r JOIN n ON n.source = r.source AND n.k = r.k + 1))
SELECT source, id, phrase FROM r""")
def phrase_packing(spark, sf_dir):
    return greedy.phrases(segments(spark, sf_dir), ["source"], 500, 900)


def _boxes(spark, sf_dir):
    x = lambda k: F.col("embedding")[k].cast("double") * 100
    return table(spark, sf_dir, "embeddings").select(F.lit(0).alias("source"), F.col("vec_id").alias("id"), F.col("label").alias("label"), F.col("vec_id").cast("double").alias("at"), x(0).alias("x1"), x(1).alias("y1"), (x(0) + 150).alias("x2"), (x(1) + 150).alias("y2"))


_BOXES = """b0 AS (SELECT vec_id AS id, label, vec_id::DOUBLE AS "at", embedding[1]::DOUBLE * 100 AS x1, embedding[2]::DOUBLE * 100 AS y1 FROM embeddings), b AS (SELECT *, x1 + 150 AS x2, y1 + 150 AS y2, "at" + 30 AS "end" FROM b0)"""


def _shared(a: str, b: str) -> str:
    """Intersection over union of two boxes."""
    both = f"greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    area = lambda r: f"(greatest(0.0, {r}.x2 - {r}.x1) * greatest(0.0, {r}.y2 - {r}.y1))"
    return f"(CASE WHEN {both} > 0 THEN {both} / ({area(a)} + {area(b)} - {both}) ELSE 0.0 END)"


_LIKE = """(greatest(0.0, x.x2 - x.x1) * greatest(0.0, x.y2 - x.y1))"""
_FIT = f"""({_shared("n", "x")} + 0.35::DOUBLE * greatest(0.0, 1 - sqrt(power((n.x1 + n.x2) / 2 - (x.x1 + x.x2) / 2, 2) + power((n.y1 + n.y2) / 2 - (x.y1 + x.y2) / 2, 2)) / greatest(2000 * 0.18::DOUBLE, 1.0))
 + 0.15::DOUBLE * (least({_LIKE.replace("x.", "n.")}, {_LIKE}) / greatest({_LIKE.replace("x.", "n.")}, {_LIKE}, 1.0)))"""


@query("box_tracks", f"""WITH RECURSIVE {_BOXES}, n AS (SELECT label, {{'id': id, 'at': "at", 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} AS n, row_number() OVER (PARTITION BY label ORDER BY "at", id) AS k FROM b),
r AS (SELECT label, k, n, [n] AS seen, 1 AS track FROM n WHERE k = 1
 UNION ALL SELECT label, k, n, CASE WHEN to_ = len(seen) + 1 THEN list_append(seen, n) ELSE list_transform(seen, lambda x, i: CASE WHEN i = to_ THEN n ELSE x END) END, CAST(to_ AS INTEGER)
 FROM (SELECT *, CASE WHEN best IS NULL OR (list_extract(shared, best) < 0.3 AND list_extract(fits, best) < 0.42) THEN len(seen) + 1 ELSE best END AS to_
  FROM (SELECT *, CASE WHEN list_max(fits) IS NOT NULL THEN list_position(fits, list_max(fits)) END AS best FROM (SELECT n.label, n.k, n.n, r.seen, list_transform(r.seen, lambda x: CASE WHEN n.n."at" - x."at" BETWEEN -0.001 AND 40 THEN {_FIT.replace("n.", "n.n.")} END) AS fits,
   list_transform(r.seen, lambda x: {_shared("n.n", "x")}) AS shared FROM r JOIN n ON n.label = r.label AND n.k = r.k + 1))))
SELECT 0 AS source, label, n.id AS id, track FROM r""")
def box_tracks(spark, sf_dir):
    return greedy.tracks(_boxes(spark, sf_dir), ["source"], 2000.0, 40.0, 0.3)


@query("merged_boxes", f"""WITH RECURSIVE {_BOXES}, n AS (SELECT label, {{'start': "at", 'end': "end", 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'n': 1}} AS n, row_number() OVER (PARTITION BY label ORDER BY "at", "end", x1, y1) AS k FROM b),
r AS (SELECT label, k, [n] AS kept FROM n WHERE k = 1
 UNION ALL SELECT label, k, CASE WHEN into_ IS NULL THEN list_append(kept, n) ELSE list_transform(kept, lambda x, i: CASE WHEN i = into_ THEN {{'start': least(x.start, n.start), 'end': greatest(x."end", n."end"), 'x1': least(x.x1, n.x1), 'y1': least(x.y1, n.y1),
   'x2': greatest(x.x2, n.x2), 'y2': greatest(x.y2, n.y2), 'n': x.n + 1}} ELSE x END) END
 FROM (SELECT n.label, n.k, n.n, r.kept, list_position(list_transform(r.kept, lambda x: least(x."end", n.n."end") > greatest(x.start, n.n.start) AND {_shared("x", "n.n")} >= 0.5), TRUE) AS into_ FROM r JOIN n ON n.label = r.label AND n.k = r.k + 1)),
l AS (SELECT label, unnest(kept) AS x FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY k DESC) = 1)
SELECT 0 AS source, label, x.start AS start, x."end" AS "end", x.x1 AS x1, x.y1 AS y1, x.x2 AS x2, x.y2 AS y2, CAST(x.n AS BIGINT) AS n FROM l""")
def merged_boxes(spark, sf_dir):
    boxes = _boxes(spark, sf_dir).withColumn("start", F.col("at")).withColumn("end", F.col("at") + 30)
    return greedy.merged_boxes(boxes, ["source"], 0.5)


@query("adjacent_repeats")
def adjacent_repeats(spark, sf_dir):
    rows = segments(spark, sf_dir).withColumn("normal", without_fillers(F.col("text"), ("the",)))
    return greedy.adjacent_repeats(rows, ["source"], 0.3)
