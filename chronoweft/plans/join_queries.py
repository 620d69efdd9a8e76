"""Queries over overlap, nearest and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.operators import intervals, joins
from chronoweft.plans.registry import query
from chronoweft.plans.views import SPANS, UNITS, spans, units

_WIDTH = 36_000_000


def _sides(spark, sf_dir):
    u = units(spark, sf_dir)
    return u.filter("speaker IN ('view', 'click')"), u.filter("speaker NOT IN ('view', 'click')")


_SIDES = f"{UNITS}, a AS (SELECT * FROM u WHERE speaker IN ('view', 'click')), b AS (SELECT * FROM u WHERE speaker NOT IN ('view', 'click'))"


@query("interval_overlap_join", f"""WITH {_SIDES} SELECT a.source, a.id AS l_id, b.id AS r_id, least(a."end", b."end") - greatest(a.start, b.start) AS overlap
FROM a JOIN b ON a.source = b.source AND a.start < b."end" AND b.start < a."end" WHERE a."end" > a.start AND b."end" > b.start""")
def interval_overlap_join(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return joins.overlap_join(a, b, ["source"], _WIDTH).select("source", "l_id", "r_id", joins.overlap_length().alias("overlap"))


@query("assign_speakers", f"""WITH {_SIDES},
p AS (SELECT a.source, a.id, a.start, a."end", b.speaker, sum(least(a."end", b."end") - greatest(a.start, b.start)) AS score, min(b.start) AS first
 FROM a JOIN b ON a.source = b.source AND a.start < b."end" AND b.start < a."end" GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY score DESC, first, speaker) AS k, sum(score) OVER (PARTITION BY source, id) AS total FROM p),
e AS (SELECT source, id, any_value(total) AS total, max(CASE WHEN k = 1 THEN speaker END) AS assigned, coalesce(max(CASE WHEN k = 2 THEN score END), 0) AS second FROM r GROUP BY source, id)
SELECT a.source, a.id, a.start, a."end", coalesce(assigned, 'unknown') AS assigned, CASE WHEN total IS NULL THEN 0.0 ELSE least(1.0, total / (a."end" - a.start)) END AS coverage,
 concat_ws(',', CASE WHEN total IS NULL THEN 'unlabeled' END, CASE WHEN total / (a."end" - a.start) < 0.5 THEN 'low_overlap' END, CASE WHEN second / total >= 0.25 THEN 'mixed' END) AS warnings
FROM a LEFT JOIN e USING (source, id)""")
def assign_speakers(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return joins.assign_speakers(a, b, ["source"], _WIDTH)


@query("crosstalk", f"""WITH {UNITS} SELECT a.source, a.id AS a_id, b.id AS b_id, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end", least(a."end", b."end") - greatest(a.start, b.start) AS overlap
FROM u a JOIN u b ON a.source = b.source AND (a.start, a."end", a.id) < (b.start, b."end", b.id) AND a.speaker <> b.speaker AND b.start < a."end" WHERE least(a."end", b."end") - greatest(a.start, b.start) >= 200000""")
def crosstalk(spark, sf_dir):
    return joins.crosstalk(units(spark, sf_dir), ["source"], _WIDTH, 200_000)


def _cuts(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return a.select("source", "id", F.col("start").alias("at")), b.select("source", F.col("start").alias("at"))


_CUTS = f"""{_SIDES}, c AS (SELECT source, id, start AS "at" FROM a), m AS (SELECT DISTINCT source, start AS "at" FROM b)"""


@query("as_of_backward", f"""WITH {_CUTS} SELECT c.source, c.id, c."at", CASE WHEN c."at" - m."at" <= 20000000 THEN m."at" END AS matched FROM c ASOF LEFT JOIN m ON c.source = m.source AND c."at" >= m."at"
""")
def as_of_backward(spark, sf_dir):
    cuts, marks = _cuts(spark, sf_dir)
    return joins.as_of(cuts, marks, ["source"], tolerance=20_000_000)


@query("as_of_forward", f"""WITH {_CUTS} SELECT c.source, c.id, c."at", CASE WHEN m."at" - c."at" <= 20000000 THEN m."at" END AS matched FROM c ASOF LEFT JOIN m ON c.source = m.source AND c."at" <= m."at"
""")
def as_of_forward(spark, sf_dir):
    cuts, marks = _cuts(spark, sf_dir)
    return joins.as_of(cuts, marks, ["source"], tolerance=20_000_000, forward=True)


_NEAR = f"""{_CUTS}, n AS (SELECT c.source, c.id, c."at", m."at" AS near, row_number() OVER (PARTITION BY c.source, c.id ORDER BY abs(m."at" - c."at"), m."at") AS k FROM c LEFT JOIN m ON c.source = m.source)"""


@query("nearest_join", f"""WITH {_NEAR} SELECT source, id, "at", near AS nearest FROM n WHERE k = 1""")
def nearest_join(spark, sf_dir):
    cuts, marks = _cuts(spark, sf_dir)
    return joins.nearest(cuts, marks, ["source"])


@query("snap_to_beats", f"""WITH {_NEAR} SELECT source, id, "at", CASE WHEN abs(near - "at") <= 3000000 THEN near ELSE "at" END AS snapped FROM n WHERE k = 1""")
def snap_to_beats(spark, sf_dir):
    cuts, marks = _cuts(spark, sf_dir)
    return joins.snap(cuts, marks, ["source"], 3_000_000)


@query("point_in_interval", f"""WITH {_CUTS}, h AS (SELECT c.source, c.id, c."at", b.id AS interval, row_number() OVER (PARTITION BY c.source, c.id ORDER BY b.start, b.id) AS k
 FROM c LEFT JOIN b ON c.source = b.source AND c."at" BETWEEN b.start AND b."end") SELECT source, id, "at", interval FROM h WHERE k = 1""")
def point_in_interval(spark, sf_dir):
    cuts, _ = _cuts(spark, sf_dir)
    return joins.within(cuts, _sides(spark, sf_dir)[1], ["source"], _WIDTH)


@query("static_silences", f"""WITH {SPANS},
r0 AS (SELECT *, max("end") OVER (PARTITION BY source ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM x WHERE flag = 'R' AND "end" > start),
r1 AS (SELECT *, sum(CASE WHEN far IS NULL OR start > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM r0),
r AS (SELECT source, min(start) AS start, max("end") AS "end" FROM r1 GROUP BY source, k),
a0 AS (SELECT *, max("end") OVER (PARTITION BY source ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM x WHERE flag = 'A' AND "end" > start),
a1 AS (SELECT *, sum(CASE WHEN far IS NULL OR start > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM a0),
a AS (SELECT source, min(start) AS start, max("end") AS "end" FROM a1 GROUP BY source, k)
SELECT r.source, r.start, r."end", CAST(sum(least(r."end", a."end") - greatest(r.start, a.start)) AS BIGINT) AS shared FROM r JOIN a ON r.source = a.source AND r.start < a."end" AND a.start < r."end"
GROUP BY ALL HAVING sum(least(r."end", a."end") - greatest(r.start, a.start)) >= 0.5 * (r."end" - r.start)""")
def static_silences(spark, sf_dir):
    rows = spans(spark, sf_dir)
    silences, freezes = (intervals.merge(rows.filter(F.col("flag") == f), ["source"], 1).drop("pieces") for f in "RA")
    pairs = joins.overlap_join(silences, freezes, ["source"], 2000)
    shared = pairs.groupBy("source", F.col("l_start").alias("start"), F.col("l_end").alias("end")).agg(F.sum(joins.overlap_length()).alias("shared"))
    return shared.filter("shared >= 0.5 * (end - start)")
