"""Queries over pairs, components and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.functions import geometry
from chronoweft.operators import graph, signal, similarity
from chronoweft.plans.registry import query
from chronoweft.plans.views import millis, table


def _signatures(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), geometry.sign_bits(F.col("embedding")).alias("signature"), F.col("label").alias("source"))


_PAIRS = """v AS (SELECT vec_id AS id, list_sum([CASE WHEN embedding[i] > 0 THEN 1::HUGEINT << (i - 1) ELSE 0 END FOR i IN range(1, 64)])::BIGINT AS s, label FROM embeddings),
p AS (SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.s, b.s)) AS INTEGER) AS distance FROM v a JOIN v b ON a.id < b.id WHERE bit_count(xor(a.s, b.s)) <= 17)"""


@query("signature_pairs", f"WITH {_PAIRS} SELECT a, b, distance FROM p")
def signature_pairs(spark, sf_dir):
    return similarity.signature_pairs(_signatures(spark, sf_dir), 17)


@query("duplicate_groups", f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT id AS a, id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS id, min(b) AS component FROM r GROUP BY a), q AS (SELECT c.*, row_number() OVER (PARTITION BY component ORDER BY label DESC, v.id) AS k FROM c JOIN v USING (id))
SELECT id, component, k = 1 AS keep FROM q""")
def duplicate_groups(spark, sf_dir):
    rows = _signatures(spark, sf_dir)
    classes = graph.components(similarity.signature_pairs(rows, 17))
    return graph.keepers(rows, classes, [F.desc("source")]).select("id", "component", "keep")


@query("sequence_ratio")
def sequence_ratio(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", similarity.repeat_score(F.col("text"), F.col("after")).alias("score"))


@query("script_alignment", "SELECT item_id, doc_id, CAST(strpos(d.text, b.text) AS INTEGER) AS \"at\" FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''")
def script_alignment(spark, sf_dir):
    return similarity.exact_matches(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 4)


@query("boundary_overlap", r"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM conversations), n AS (SELECT conv_id, turn, ws, lead(ws) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM w)
SELECT conv_id, turn, CAST(coalesce(list_max([k FOR k IN [1, 2, 3] IF len(ws) >= k AND len(nx) >= k AND ws[len(ws) - k + 1 : len(ws)] = nx[1 : k]]), 0) AS INTEGER) AS units FROM n WHERE nx IS NOT NULL""")
def boundary_overlap(spark, sf_dir):
    from pyspark.sql import Window

    ws = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", ws.alias("ws")).withColumn("nx", F.lead("ws").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("nx IS NOT NULL")
    return rows.select("conv_id", "turn", similarity.boundary_overlap(F.col("ws"), F.col("nx"), 1, 3).alias("units"))


_SERIES = """h AS (SELECT user_id AS source, CAST(floor((epoch_us(ts) // 1000) / 21600000) AS BIGINT) AS frame, sum(CAST(floor(value * 100) AS BIGINT))::DOUBLE AS value FROM events GROUP BY 1, 2),
g AS (SELECT source, frame + 3 AS frame, value FROM h)"""
_LAGS = f"""{_SERIES}, l AS (SELECT h.source, CAST(k AS INTEGER) AS lag, sum(h.value * g.value) AS product FROM (SELECT unnest(range(-6, 7)) AS k) JOIN h ON TRUE JOIN g ON h.source = g.source AND g.frame = h.frame + k GROUP BY ALL),
e AS (SELECT source, sum(value * value) AS e FROM h GROUP BY source), s AS (SELECT l.source, lag, product / sqrt(e * e) AS score FROM l JOIN e USING (source))"""


def _lags(spark, sf_dir):
    frame = F.floor(millis("ts") / 21_600_000)
    a = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source"), frame.alias("frame")).agg(F.sum(F.floor(F.col("value") * 100)).cast("double").alias("value"))
    return signal.lag_scores(a, a.withColumn("frame", F.col("frame") + 3), ["source"], 6)


@query("lag_scores", f"WITH {_LAGS} SELECT source, lag, score FROM s")
def lag_scores(spark, sf_dir):
    return _lags(spark, sf_dir)


@query("estimate_offset", f"""WITH {_LAGS}, b AS (SELECT source, lag AS best, score AS top FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, abs(lag), lag) = 1)
SELECT b.source, best AS lag, any_value(top) AS score, any_value(top) - coalesce(max(CASE WHEN abs(s.lag - best) > 2 THEN s.score END), 0) AS margin FROM b JOIN s USING (source) GROUP BY b.source, best""")
def estimate_offset(spark, sf_dir):
    return signal.best_lag(_lags(spark, sf_dir), ["source"])


@query("clock_drift", """WITH p AS (SELECT user_id AS source, event_id::DOUBLE AS t, event_id * 0.001::DOUBLE + value / 1000 AS y, value FROM events WHERE value >= 5), f AS (SELECT source, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, count(*) AS n, max(t) - min(t) AS span FROM p GROUP BY source),
r AS (SELECT p.source, max(abs(y - slope * t - intercept)) AS residual FROM p JOIN f USING (source) GROUP BY p.source)
SELECT source, slope, intercept, n, span, residual, CASE WHEN n < 4 THEN 'too_few' WHEN span < 100 OR residual > 0.2 THEN 'untrusted' ELSE 'fitted' END AS status FROM f JOIN r USING (source)""")
def clock_drift(spark, sf_dir):
    t = F.col("event_id").cast("double")
    probes = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), t.alias("at"), (F.col("event_id") * 0.001 + F.col("value") / 1000).alias("offset"), F.col("value").alias("confidence"))
    return signal.drift(probes, ["source"], 5, 100, 0.2)


@query("box_iou", """WITH b AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, 50 + abs(embedding[3]::DOUBLE * 100) AS w, 50 + abs(embedding[4]::DOUBLE * 100) AS h FROM embeddings), p AS (SELECT a.id AS a, c.id AS b,
 greatest(0, least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x)) * greatest(0, least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y)) AS i, a.w * a.h + c.w * c.h AS s FROM b a JOIN b c ON c.id = a.id + 1)
SELECT a, b, CASE WHEN i > 0 THEN i / (s - i) ELSE 0 END AS iou FROM p""")
def box_iou(spark, sf_dir):
    e = F.col("embedding")
    d = lambda k: e[k].cast("double") * 100
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), geometry.box(d(0), d(1), d(0) + 50 + F.abs(d(2)), d(1) + 50 + F.abs(d(3))).alias("box"))
    after = rows.select((F.col("id") - 1).alias("id"), F.col("id").alias("b"), F.col("box").alias("next"))
    return rows.join(after, "id").select(F.col("id").alias("a"), "b", geometry.iou(F.col("box"), F.col("next")).alias("iou"))


@query("match_score")
def match_score(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.lower("text").alias("after"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", similarity.match_score(F.lower("text"), F.col("after")).alias("score"))


@query("clip_pairs", """WITH v AS (SELECT vec_id % 100 AS id, label AS source, 10 + (vec_id % 100) % 7 AS duration, CAST(floor(vec_id / 100) AS BIGINT) AS fraction, list_sum([CASE WHEN embedding[i] > 0 THEN 1::HUGEINT << (i - 1) ELSE 0 END FOR i IN range(1, 64)])::BIGINT AS s,
 embedding[1]::DOUBLE * 100 AS r, embedding[2]::DOUBLE * 100 AS g, embedding[3]::DOUBLE * 100 AS b FROM embeddings),
p AS (SELECT a.id AS a, c.id AS b, greatest(bit_count(xor(a.s, c.s)), CAST(round_even(sqrt(power(a.r - c.r, 2) + power(a.g - c.g, 2) + power(a.b - c.b, 2)) / sqrt(3 * 255.0::DOUBLE ** 2) * 32, 0) AS INTEGER)) AS d
 FROM v a JOIN v c ON a.fraction = c.fraction AND a.id < c.id AND a.source <> c.source AND least(a.duration, c.duration) >= 0.7 * greatest(a.duration, c.duration))
SELECT a, b, median(d)::DOUBLE AS median, count(*) FILTER (d <= 24) AS matched, count(*) AS compared FROM p GROUP BY a, b HAVING count(*) FILTER (d <= 24) >= 1 AND median(d) <= 24""")
def clip_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    colour = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 100)
    clip = F.col("vec_id") % 100
    samples = e.select(clip.alias("id"), F.col("label").alias("source"), (clip % 7 + 10).alias("duration"), F.floor(F.col("vec_id") / 100).alias("fraction"), geometry.sign_bits(F.col("embedding")).alias("signature"), colour.alias("rgb"))
    return similarity.clip_pairs(samples, 24, 1, 0.7)
