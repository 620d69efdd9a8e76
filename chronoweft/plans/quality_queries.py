"""Queries over checks and their roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.operators import findings, intervals
from chronoweft.plans.registry import query
from chronoweft.plans.views import SEGMENTS, SPANS, UNITS, segments, spans, units

_CUES = f"""{SEGMENTS}, c AS (SELECT *, [trim(x) FOR x IN string_split(text, chr(10)) IF trim(x) <> ''] AS lines,
 lag(start) OVER (PARTITION BY source ORDER BY id) AS before, max("end") OVER (PARTITION BY source ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s),
v AS (SELECT source, id, start, "end", "end" - start AS d, lines, length(array_to_string(lines, '')) AS n, list_max([length(x) FOR x IN lines]) AS longest, before, far FROM c),
f AS (SELECT source, id, 'flash_cue' AS kind, 'block' AS severity, d::DOUBLE AS value, 1000::DOUBLE AS "limit" FROM v WHERE d > 0 AND d < 1000
 UNION ALL SELECT source, id, 'non_positive_duration', 'block', d, 1000 FROM v WHERE d <= 0
 UNION ALL SELECT source, id, 'non_monotonic_order', 'block', start, NULL FROM v WHERE start < before
 UNION ALL SELECT source, id, 'empty_text', 'block', NULL, NULL FROM v WHERE coalesce(n, 0) = 0
 UNION ALL SELECT source, id, 'short_duration', 'warn', d, 4000 FROM v WHERE d >= 1000 AND d < 4000
 UNION ALL SELECT source, id, 'long_duration', 'warn', d, 20000 FROM v WHERE d > 20000
 UNION ALL SELECT source, id, 'cps_over_max', 'block', n * 1000 / d, 18 FROM v WHERE d > 0 AND n * 1000 / d > 18
 UNION ALL SELECT source, id, 'cps_high', 'warn', n * 1000 / d, 17.9 FROM v WHERE d > 0 AND n * 1000 / d > 17.9 AND n * 1000 / d <= 18
 UNION ALL SELECT source, id, 'too_many_lines', 'warn', len(lines), 2 FROM v WHERE len(lines) > 2
 UNION ALL SELECT source, id, 'line_too_long', 'warn', longest, 300 FROM v WHERE longest > 300
 UNION ALL SELECT source, id, 'cue_overlap', 'block', far - start, 0 FROM v WHERE d > 0 AND start < far)"""


def _cue_findings(spark, sf_dir):
    return findings.cue_checks(segments(spark, sf_dir), ["source"], 17.9, 18, 1000, 4000, 20000, 2, 300)


@query("cue_readability", f"WITH {_CUES} SELECT * FROM f")
def cue_readability(spark, sf_dir):
    return _cue_findings(spark, sf_dir)


@query("findings_rollup", f"""WITH {_CUES}, k AS (SELECT source, count(*) FILTER (severity = 'block') AS blocking, count(*) FILTER (severity = 'warn') AS warnings FROM f GROUP BY source),
e AS (SELECT source, coalesce(blocking, 0) AS blocking, coalesce(warnings, 0) AS warnings FROM (SELECT DISTINCT source FROM s) LEFT JOIN k USING (source))
SELECT *, CASE WHEN blocking > 0 THEN 'blocked' WHEN warnings > 0 THEN 'review' ELSE 'ready' END AS status FROM e""")
def findings_rollup(spark, sf_dir):
    return findings.summary(_cue_findings(spark, sf_dir), segments(spark, sf_dir), ["source"])


_SHOTS = f"""{SPANS}, d AS (SELECT DISTINCT source, CAST(2700000 AS BIGINT) AS duration FROM x), b AS (SELECT DISTINCT x.source, start AS p FROM x JOIN d USING (source) WHERE flag = 'R' AND start > 0 AND start < duration),
p AS (SELECT source, p FROM b UNION SELECT source, 0 FROM d UNION SELECT source, duration FROM d), h AS (SELECT source, lead(p) OVER (PARTITION BY source ORDER BY p) - p AS d FROM p), g AS (SELECT * FROM h WHERE d IS NOT NULL)"""


def _boundaries(spark, sf_dir):
    rows = spans(spark, sf_dir)
    lengths = rows.select("source").distinct().withColumn("duration", F.lit(2_700_000).cast("long"))
    return rows.filter("flag = 'R'").select("source", F.col("start").alias("at")).distinct(), lengths


@query("shot_rhythm", f"""WITH {_SHOTS} SELECT source, count(*) AS shots, avg(d) AS mean, quantile_disc(d, 0.5)::DOUBLE AS median, quantile_disc(d, 0.9)::DOUBLE AS p90, CASE WHEN count(*) > 1 THEN stddev_pop(d) / avg(d) ELSE 0 END AS variation,
 count(*) FILTER (d < 1000) / count(*) AS short_share FROM g GROUP BY source""")
def shot_rhythm(spark, sf_dir):
    return findings.rhythm(intervals.consecutive(*_boundaries(spark, sf_dir), ["source"]), ["source"])


@query("phase_thirds", f"""WITH {_SHOTS} SELECT source, CAST(least(2, p * 3 // 2700000) AS INTEGER) AS phase, count(*) AS n FROM b GROUP BY ALL""")
def phase_thirds(spark, sf_dir):
    at, lengths = _boundaries(spark, sf_dir)
    return findings.phase_thirds(at.filter("at > 0 AND at < 2700000"), lengths, ["source"])


@query("motion_guard", f"""WITH {UNITS}, k AS (SELECT source, start, "end", "end" - start AS d, CASE WHEN speaker IN ('view', 'purchase') THEN 'motion' WHEN speaker = 'click' THEN 'still' ELSE 'unknown' END AS kind FROM u),
r1 AS (SELECT *, sum(CASE WHEN kind = 'motion' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run_id FROM k),
r2 AS (SELECT source, run_id, sum(CASE WHEN kind = 'motion' THEN 0 ELSE d END) AS run FROM r1 GROUP BY ALL), r AS (SELECT source, CAST(max(run) AS BIGINT) AS still_run FROM r2 GROUP BY source),
t AS (SELECT source, CAST(sum(d) AS BIGINT) AS length, CAST(sum(CASE WHEN kind = 'motion' THEN d ELSE 0 END) AS BIGINT) AS motion FROM k GROUP BY source)
SELECT source, length, motion, still_run, CASE WHEN motion < length * 0.4 THEN 'blocked' WHEN still_run > 100000000 THEN 'review' ELSE 'ready' END AS status FROM t JOIN r USING (source)""")
def motion_guard(spark, sf_dir):
    kind = F.when(F.col("speaker").isin("view", "purchase"), "motion").when(F.col("speaker") == "click", "still").otherwise("unknown")
    return findings.motion_guard(units(spark, sf_dir).withColumn("kind", kind), ["source"], 0.4, 100_000_000)
