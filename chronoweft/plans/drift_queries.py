"""Queries over clock drift measured in windows. Recordings are the items of a supplier in order; the other recording of each is 3 frames late and loses one frame in 120."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweft.operators import drift
from chronoweft.plans.registry import query
from chronoweft.plans.views import table

_BASE, _PROBES, _WINDOW, _SEARCH, _STEP = 3, 8, 80, 8, 0.05
_SIZE = _WINDOW + 2 * _SEARCH

_PROBED = f"""a AS (SELECT l_suppkey AS source, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS frame, l_quantity::DOUBLE AS value FROM lineitem),
b AS (SELECT source, frame - {_BASE} - frame // 120 AS frame, max(value) AS value FROM a WHERE frame - {_BASE} - frame // 120 >= 0 GROUP BY ALL),
x AS (SELECT source, na, nb FROM (SELECT source, max(frame) + 1 AS na FROM a GROUP BY source) JOIN (SELECT source, max(frame) + 1 AS nb FROM b GROUP BY source) USING (source)),
y AS (SELECT source, {_BASE + _SEARCH} AS lo, least(na - {_WINDOW + _SEARCH}, nb + {_BASE} - {_WINDOW + _SEARCH}) AS hi FROM x),
c AS (SELECT source, i AS probe, lo + ((hi - lo) * i) // {_PROBES - 1} AS core FROM y, range({_PROBES}) r(i) WHERE hi >= lo),
w AS (SELECT source, probe, k, core - {_SEARCH} + k AS fa, core - {_BASE + _SEARCH} + k AS fb FROM c, range({_SIZE}) t(k)),
v AS (SELECT w.source, probe, k, 'a' AS side, coalesce(value, 0) AS value FROM w LEFT JOIN a ON a.source = w.source AND frame = fa UNION ALL SELECT w.source, probe, k, 'b', coalesce(value, 0) FROM w LEFT JOIN b ON b.source = w.source AND frame = fb),
g AS (SELECT source, probe, side, list_sort(list(value))[{round((_SIZE - 1) * 0.2) + 1}] AS low, max(value) AS high FROM v GROUP BY ALL),
e AS (SELECT v.*, CASE WHEN high - low <= 1e-9 THEN 0 ELSE greatest(0, (value - low) / (high - low)) END AS en FROM v JOIN g USING (source, probe, side)),
f AS (SELECT *, 0.8::DOUBLE * en + 0.2::DOUBLE * greatest(0, en - coalesce(lag(en) OVER (PARTITION BY source, probe, side ORDER BY k), 0)) AS f FROM e),
n AS (SELECT source, probe, sum(f * f) FILTER (side = 'a') AS ta, sum(f * f) FILTER (side = 'b') AS tb FROM f GROUP BY ALL),
s AS (SELECT l.source, l.probe, lag::INT AS lag, sum(l.f * r.f) AS d, sum(l.f * l.f) AS sa, sum(r.f * r.f) AS sb FROM f l, range({-_SEARCH}, {_SEARCH + 1}) m(lag), f r WHERE l.side = 'a' AND r.side = 'b' AND r.source = l.source AND r.probe = l.probe AND r.k = l.k - lag GROUP BY ALL HAVING sa > 1e-9 AND sb > 1e-9),
z AS (SELECT source, probe, lag, d / sqrt(sa * sb) * least(1.0::DOUBLE, sa / ta, sb / tb) AS score FROM s JOIN n USING (source, probe)),
k AS (SELECT *, row_number() OVER o AS k, first(lag) OVER o AS best FROM z WINDOW o AS (PARTITION BY source, probe ORDER BY round(score, 9) DESC, lag)),
h AS (SELECT source, probe, any_value(best) AS lag, max(score) FILTER (k = 1) AS score, max(score) FILTER (k = 1) - coalesce(max(score) FILTER (abs(lag - best) > 2), max(score) FILTER (k = 2), -1) AS margin FROM k GROUP BY source, probe),
q AS (SELECT source, probe::INT AS probe, (core + {_WINDOW / 2}::DOUBLE) * {_STEP}::DOUBLE AS "at", (lag + {_BASE}) * {_STEP}::DOUBLE AS "offset", score, margin, 0.8::DOUBLE * greatest(0, least(1.0::DOUBLE, score)) + 0.2::DOUBLE * greatest(0, least(1.0::DOUBLE, margin / 0.12::DOUBLE)) AS confidence, lag FROM h JOIN c USING (source, probe)),
p AS (SELECT source, probe, "at", "offset", score, margin, confidence, CASE WHEN {_SEARCH} - abs(lag) <= 1 THEN 'search_boundary' WHEN confidence < 0.6 THEN 'low_confidence' ELSE 'accepted' END AS status FROM q)"""


def _recordings(spark, sf_dir):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_quantity")
    a = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), (F.row_number().over(order) - 1).cast("long").alias("frame"), F.col("l_quantity").cast("double").alias("value"))
    late = F.col("frame") - _BASE - F.floor(F.col("frame") / 120)
    b = a.select("source", late.alias("frame"), "value").filter("frame >= 0").groupBy("source", "frame").agg(F.max("value").alias("value"))
    return a, b


def _probes(a, b):
    cores = drift.probe_cores(a, b, ["source"], _BASE, _PROBES, _WINDOW, _SEARCH)
    scores = drift.window_scores(a, b, cores, ["source"], _BASE, _WINDOW, _SEARCH)
    return drift.probe_offsets(scores, ["source"], _BASE, _WINDOW, _SEARCH, 0.6, _STEP)


@query("drift_probes", f"WITH {_PROBED} SELECT * FROM p")
def drift_probes(spark, sf_dir):
    return _probes(*_recordings(spark, sf_dir))


@query("measured_drift", f"""WITH {_PROBED}, t AS MATERIALIZED (SELECT source, "at" AS t, "offset" AS y FROM p WHERE status = 'accepted'),
l AS (SELECT a.source, a.t AS lat, b.t AS rat, (b.y - a.y) / (b.t - a.t) AS s, a.y - (b.y - a.y) / (b.t - a.t) * a.t AS i FROM t a JOIN t b ON a.source = b.source AND a.t < b.t),
u AS (SELECT l.source, lat, rat, s, i, count(*) AS n, median(abs(y - i - s * t)) AS m FROM l JOIN t ON l.source = t.source AND abs(y - i - s * t) <= 0.1 GROUP BY ALL),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, round(m, 9), round(abs(s), 12), lat, rat) = 1),
j AS (SELECT t.* FROM t JOIN o ON t.source = o.source AND abs(y - i - s * t) <= 0.1), r AS (SELECT source, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, count(*) AS inliers, max(t) - min(t) AS span FROM j GROUP BY source),
ww AS (SELECT j.source, max(abs(y - slope * t - intercept)) AS worst FROM j JOIN r USING (source) GROUP BY j.source), cc AS (SELECT source, count(*) AS probes FROM t GROUP BY source),
dd AS (SELECT x.source, coalesce(probes, 0) AS probes, inliers, slope, intercept, span, worst, CASE WHEN coalesce(probes, 0) < 4 THEN 'too_few_confident_probes' WHEN inliers IS NULL THEN 'probe_times_not_distinct' WHEN inliers < 4 THEN 'too_few_consensus_inliers'
 ELSE concat_ws(',', CASE WHEN span < 4 THEN 'probe_span_too_short' END, CASE WHEN worst > 0.1 THEN 'fit_residual_too_large' END, CASE WHEN abs(slope) * 1e6 > 20000 THEN 'drift_rate_implausible' END) END AS reasons
 FROM (SELECT DISTINCT source FROM a) x LEFT JOIN cc USING (source) LEFT JOIN r USING (source) LEFT JOIN ww USING (source))
SELECT *, CASE WHEN reasons <> '' THEN 'unreliable' WHEN abs(slope * span) > 0.08 THEN 'correction_required' ELSE 'stable' END AS status FROM dd""")
def measured_drift(spark, sf_dir):
    a, b = _recordings(spark, sf_dir)
    return drift.measured(a, _probes(a, b), ["source"], 0.6, 0.1, 4, 20000, 0.08)
