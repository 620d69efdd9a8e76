"""Queries over all events as one timeline, cut into ranges. The SQL sorts the timeline as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.operators import scans
from chronoweft.plans.registry import query
from chronoweft.plans.views import UNITS, units

_GAP, _LEAST, _TOLERANCE = 60_000, 200_000, 900_000
_ONE = UNITS.replace("user_id AS source", "0 AS source")


def _one(spark, sf_dir):
    return units(spark, sf_dir).withColumn("source", F.lit(0))


_FAR = """g AS (SELECT *, max("end") OVER (ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM u WHERE "end" > start)"""


@query("one_timeline_merged", f"""WITH {_ONE}, {_FAR}, i AS (SELECT *, sum(CASE WHEN far IS NULL OR start > far + {_GAP} THEN 1 ELSE 0 END) OVER (ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT source, min(start) AS start, max("end") AS "end", count(*) AS pieces FROM i GROUP BY source, island""")
def one_timeline_merged(spark, sf_dir):
    return scans.merge(_one(spark, sf_dir), ["source"], _GAP)


@query("one_timeline_gaps", f"""WITH {_ONE}, {_FAR} SELECT source, far AS start, start AS "end" FROM g WHERE start - far > {_LEAST}""")
def one_timeline_gaps(spark, sf_dir):
    return scans.gaps(_one(spark, sf_dir), ["source"], _LEAST)


@query("one_timeline_turns", f"""WITH {_ONE}, a AS (SELECT *, lag(speaker) OVER (ORDER BY start, "end", id) AS before, row_number() OVER (ORDER BY start, "end", id) AS k FROM u),
b AS (SELECT *, sum(CASE WHEN k > 1 AND before IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END) OVER (ORDER BY k) AS run FROM a),
c AS (SELECT *, max("end") OVER (PARTITION BY run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM b),
d AS (SELECT *, sum(CASE WHEN far IS NULL OR start - far > {_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY k) AS part FROM c)
SELECT source, speaker, min(start) AS start, max("end") AS "end", count(*) AS units FROM d GROUP BY source, run, part, speaker""")
def one_timeline_turns(spark, sf_dir):
    return scans.turns(_one(spark, sf_dir), ["source"], _GAP)


@query("one_timeline_as_of", f"""WITH {_ONE}, c AS (SELECT source, id, start AS "at" FROM u WHERE speaker <> 'error'), m AS (SELECT DISTINCT source, start AS "at" FROM u WHERE speaker = 'error')
SELECT c.source, c.id, c."at", CASE WHEN c."at" - m."at" <= {_TOLERANCE} THEN m."at" END AS matched FROM c ASOF LEFT JOIN m ON c.source = m.source AND c."at" >= m."at" """)
def one_timeline_as_of(spark, sf_dir):
    rows = _one(spark, sf_dir).select("source", "id", F.col("start").alias("at"), "speaker")
    return scans.as_of(rows.filter("speaker <> 'error'").drop("speaker"), rows.filter("speaker = 'error'"), ["source"], tolerance=_TOLERANCE)
