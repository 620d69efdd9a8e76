"""Queries over turns and interval algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.operators import intervals, turns
from chronoweft.plans.registry import query
from chronoweft.plans.views import SEGMENTS, SPANS, UNITS, millis, segments, spans, table, units

GAP = 7_200_000
_TURNS = f"""{UNITS},
t1 AS (SELECT *, CASE WHEN lag(speaker) OVER w IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END AS c FROM u WINDOW w AS (PARTITION BY source ORDER BY start, "end", id)),
t2 AS (SELECT *, sum(c) OVER (PARTITION BY source ORDER BY start, "end", id) AS run FROM t1),
t3 AS (SELECT *, max("end") OVER (PARTITION BY source, run ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM t2),
t4 AS (SELECT *, sum(CASE WHEN far IS NULL OR start - far > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY source, run ORDER BY start, "end", id) AS part FROM t3),
t AS (SELECT source, speaker, min(start) AS start, max("end") AS "end", count(*) AS units FROM t4 GROUP BY source, run, part, speaker)"""


@query("gap_merged_turns", f'WITH {_TURNS} SELECT source, speaker, start, "end", units FROM t')
def gap_merged_turns(spark, sf_dir):
    return turns.turns(units(spark, sf_dir), ["source"], GAP)


@query("talk_ratio", f"""WITH {_TURNS}, e AS (SELECT source, speaker, count(*) AS turns, CAST(sum("end" - start) AS BIGINT) AS length FROM t GROUP BY source, speaker)
SELECT *, length / sum(length) OVER (PARTITION BY source) AS talk_ratio FROM e""")
def talk_ratio(spark, sf_dir):
    return turns.talk_ratio(gap_merged_turns(spark, sf_dir), ["source"])


@query("speaker_summary", f"""WITH {_TURNS}, v AS (SELECT source, CASE WHEN speaker = 'click' THEN 'unknown' ELSE speaker END AS speaker, start, "end" FROM t),
e AS (SELECT source, count(*) AS turns, count(DISTINCT CASE WHEN speaker <> 'unknown' THEN speaker END) AS speakers, CAST(sum("end" - start) AS BIGINT) AS length,
 CAST(sum(CASE WHEN speaker = 'unknown' THEN "end" - start ELSE 0 END) AS BIGINT) AS unlabeled FROM v GROUP BY source)
SELECT *, concat_ws(',', CASE WHEN speakers < 3 THEN 'too_few_speakers' END, CASE WHEN length > 0 AND unlabeled > length * 0.3 THEN 'too_much_unlabeled' END) AS reasons,
 CASE WHEN speakers < 3 OR (length > 0 AND unlabeled > length * 0.3) THEN 'blocked' ELSE 'ready' END AS status FROM e""")
def speaker_summary(spark, sf_dir):
    found = gap_merged_turns(spark, sf_dir).withColumn("speaker", F.when(F.col("speaker") == "click", "unknown").otherwise(F.col("speaker")))
    return turns.speaker_summary(found, ["source"], 3, 0.3)


def _merged(view: str, gap: int, where: str = "TRUE", name: str = "m") -> str:
    return f"""{name}1 AS (SELECT *, max("end") OVER (PARTITION BY source ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM {view} WHERE "end" > start AND {where}),
{name}2 AS (SELECT *, sum(CASE WHEN far IS NULL OR start > far + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM {name}1),
{name} AS (SELECT source, min(start) AS start, max("end") AS "end", count(*) AS pieces FROM {name}2 GROUP BY source, island)"""


@query("merge_intervals", f'WITH {SPANS}, {_merged("x", 0)} SELECT source, start, "end", pieces FROM m')
def merge_intervals(spark, sf_dir):
    return intervals.merge(spans(spark, sf_dir), ["source"], 0, stretch=100_000)


@query("merge_intervals_gap", f'WITH {UNITS}, {_merged("u", GAP)} SELECT source, start, "end", pieces FROM m')
def merge_intervals_gap(spark, sf_dir):
    return intervals.merge(units(spark, sf_dir), ["source"], GAP)


_LENGTHS = "d AS (SELECT DISTINCT source, CAST(2700000 AS BIGINT) AS duration FROM x)"


def _lengths(rows):
    return rows.select("source").distinct().withColumn("duration", F.lit(2_700_000).cast("long"))


@query("interval_gaps", f"""WITH {UNITS}, g AS (SELECT *, max("end") OVER (PARTITION BY source ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM u WHERE "end" > start)
SELECT source, far AS start, start AS "end" FROM g WHERE start - far > {GAP}""")
def interval_gaps(spark, sf_dir):
    return intervals.gaps(units(spark, sf_dir), ["source"], GAP)


@query("complement", f"""WITH {SPANS}, {_LENGTHS}, {_merged("x", 0, "flag = 'R'")},
e AS (SELECT source, 0 AS s, 0 AS e FROM d UNION ALL SELECT source, least(start, 2700000), least("end", 2700000) FROM m UNION ALL SELECT source, duration, duration FROM d),
f AS (SELECT source, e AS start, lead(s) OVER (PARTITION BY source ORDER BY s, e) AS "end" FROM e)
SELECT source, start, "end" FROM f WHERE "end" > start""")
def complement(spark, sf_dir):
    rows = spans(spark, sf_dir)
    return intervals.complement(rows.filter("flag = 'R'"), _lengths(rows), ["source"])


_KEEP = f"""{SPANS}, {_LENGTHS}, c AS (SELECT x.source, start + 80 AS s, least(duration, "end" - 80) AS e FROM x JOIN d USING (source) WHERE flag = 'A'),
k1 AS (SELECT source, s, e FROM c WHERE e > s UNION ALL SELECT source, duration, duration FROM d),
k2 AS (SELECT source, coalesce(max(e) OVER (PARTITION BY source ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, s AS "end" FROM k1),
k AS (SELECT DISTINCT source, start, "end" FROM k2 WHERE "end" - start >= 150)"""


@query("keep_segments", f'WITH {_KEEP} SELECT source, start, "end" FROM k')
def keep_segments(spark, sf_dir):
    rows = spans(spark, sf_dir)
    return intervals.keep_segments(rows.filter("flag = 'A'"), _lengths(rows), ["source"], 80, 150)


@query("cut_plan", f"""WITH {_KEEP}, a AS (SELECT source, CAST(sum("end" - start) AS BIGINT) AS kept, count(*) AS pieces FROM k GROUP BY source)
SELECT source, duration, coalesce(kept, 0) AS kept, coalesce(pieces, 0) AS pieces, duration - coalesce(kept, 0) AS removed,
 CASE WHEN duration - coalesce(kept, 0) > duration * 0.2 THEN 'blocked' ELSE 'ready' END AS status FROM d LEFT JOIN a USING (source)""")
def cut_plan(spark, sf_dir):
    rows = spans(spark, sf_dir)
    return intervals.cut_plan(rows.filter("flag = 'A'"), _lengths(rows), ["source"], 0.2, 80, 150)


@query("shot_ranges", f"""WITH {SPANS}, {_LENGTHS}, p AS (SELECT x.source, start AS "at" FROM x JOIN d USING (source) WHERE flag = 'R' AND start > 0 AND start < duration
 UNION SELECT source, 0 FROM d UNION SELECT source, duration FROM d),
q AS (SELECT source, row_number() OVER w AS number, p.at AS start, lead(p.at) OVER w AS "end" FROM p WINDOW w AS (PARTITION BY source ORDER BY p.at))
SELECT source, CAST(number AS INTEGER) AS number, start, "end" FROM q WHERE "end" IS NOT NULL""")
def shot_ranges(spark, sf_dir):
    rows = spans(spark, sf_dir)
    return intervals.consecutive(rows.filter("flag = 'R'").select("source", F.col("start").alias("at")), _lengths(rows), ["source"])


@query("longest_run", f"""WITH {UNITS}, f AS (SELECT source, id, start, speaker IN ('view', 'click') AS flag, "end" - start AS w FROM u),
g AS (SELECT *, sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY start, id ROWS UNBOUNDED PRECEDING) AS run_id FROM f),
r AS (SELECT source, run_id, CAST(sum(CASE WHEN flag THEN w ELSE 0 END) AS BIGINT) AS run, CAST(sum(CAST(flag AS INT)) AS BIGINT) AS n FROM g GROUP BY source, run_id),
b AS (SELECT source, run, n, row_number() OVER (PARTITION BY source ORDER BY run DESC, n DESC) AS k FROM r)
SELECT source, run, n AS rows FROM b WHERE k = 1""")
def longest_run(spark, sf_dir):
    return intervals.longest_run(units(spark, sf_dir), ["source"], ["start", "id"], F.col("speaker").isin("view", "click"), F.col("end") - F.col("start"))


@query("scene_spikes", """WITH h AS (SELECT user_id AS source, CAST(floor((epoch_us(ts) // 1000) / 86400000) AS BIGINT) AS day, count(*) AS score FROM events GROUP BY 1, 2),
w AS (SELECT *, sum(score) OVER v AS total, count(*) OVER v AS n FROM h WINDOW v AS (PARTITION BY source ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
r AS (SELECT source, day, score, (total - score) / 4 AS local_average FROM w WHERE n = 5)
SELECT source, day, score, local_average, least(score / local_average, 255.0) AS ratio FROM r WHERE score >= 1 AND least(score / local_average, 255.0) >= 1.5""")
def scene_spikes(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source"), F.floor(millis("ts") / 86_400_000).alias("day")).agg(F.count("*").alias("score"))
    return intervals.local_spikes(daily, ["source"], ["day"], "score", 2, 1.5, 1)


@query("silence_gaps", f"""WITH {SEGMENTS}, g AS (SELECT source, id, start, lag("end") OVER (PARTITION BY source ORDER BY start, id) AS before FROM (SELECT * FROM s WHERE speaker = 'user'))
SELECT source, id, before AS start, start AS "end" FROM g WHERE start - before >= 500""")
def silence_gaps(spark, sf_dir):
    own = segments(spark, sf_dir).filter("speaker = 'user'")
    from pyspark.sql import Window

    before = F.lag("end").over(Window.partitionBy("source").orderBy("start", "id"))
    return own.withColumn("before", before).filter("start - before >= 500").select("source", "id", F.col("before").alias("start"), F.col("start").alias("end"))
