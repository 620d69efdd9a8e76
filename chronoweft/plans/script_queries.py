"""Queries over briefs, repeats and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.operators import planning, scripts
from chronoweft.plans.registry import query
from chronoweft.plans.views import table

_STRIP = "[ ,.;:!?()\\[\\]{{}}\"''`]+"
_STOP = ", ".join(f"'{w}'" for w in scripts.BRIEF_STOPWORDS)


@query("brief_terms", rf"""WITH b AS (SELECT conv_id, turn, text || ' "' || substr(text, 1, 9) || '" 城市夜景的灯 ' AS brief FROM conversations),
w AS (SELECT conv_id, turn, list_concat(regexp_extract_all(brief, '["''“”‘’](.*?)["''“”‘’]', 1), [x FOR x IN [regexp_replace(v, '^[_''-]+|[_''-]+$', '', 'g') FOR v IN regexp_extract_all(lower(brief), '[a-z0-9][a-z0-9''_-]*')] IF length(x) >= 3 AND x NOT IN ({_STOP})],
 ['城市夜景的灯', '城市夜景', '市夜景的', '夜景的灯', '城市夜', '市夜景', '夜景的', '景的灯', '城市', '市夜', '夜景', '景的', '的灯']) AS l FROM b),
c AS (SELECT conv_id, turn, [x FOR x IN [regexp_replace(lower(trim(regexp_replace(v, '\s+', ' ', 'g'))), '^{_STRIP.format()}|{_STRIP.format()}$', '', 'g') FOR v IN l] IF length(x) >= 2] AS l FROM w)
SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:24], '|') AS terms FROM c""")
def brief_terms(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    brief = F.concat("text", F.lit(' "'), F.substring("text", 1, 9), F.lit('" 城市夜景的灯 '))
    return c.select("conv_id", "turn", F.array_join(scripts.brief_terms(brief), "|").alias("terms"))


_TERMS = ("award", "the", "und der", "question", "que")


@query("brief_match", f"""WITH t AS (SELECT doc_id, lower(text) AS low, {list(_TERMS)} AS terms FROM documents WHERE text IS NOT NULL), h AS (SELECT *, [x FOR x IN terms IF contains(low, x)] AS hit FROM t),
m AS (SELECT *, list_sum([1 + least(1.0::DOUBLE, greatest(0, length(x) - 2) / 5.0::DOUBLE) FOR x IN terms]) AS w, coalesce(list_sum([1 + least(1.0::DOUBLE, greatest(0, length(x) - 2) / 5.0::DOUBLE) FOR x IN hit]), 0) AS g, coalesce(list_sum([(length(low) - length(replace(low, x, ''))) / length(x)::DOUBLE FOR x IN hit]), 0) AS n, list_min([strpos(low, x) - 1 FOR x IN hit]) AS first FROM h),
s AS (SELECT doc_id, array_to_string(hit, ',') AS matched, g / w AS coverage, least(1.0, n / 2.5::DOUBLE) AS frequency, coalesce(greatest(0.0, 1 - first / greatest(24, floor(length(low) * 0.35::DOUBLE))), 0) AS early FROM m)
SELECT doc_id, matched, round(coverage, 3) AS coverage, round(frequency, 3) AS frequency, round(early, 3) AS early, round(least(1.0, 0.72::DOUBLE * coverage + 0.18::DOUBLE * frequency + 0.10::DOUBLE * early), 3) AS score FROM s""")
def brief_match(spark, sf_dir):
    found = scripts.brief_match(F.col("text"), F.array(*map(F.lit, _TERMS)))
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", found.alias("m")).select("doc_id", F.array_join("m.matched", ",").alias("matched"), "m.coverage", "m.frequency", "m.early", "m.score")


_HITS = " + ".join(f"contains(lower(text), '{f}')::INT" for f in scripts.FILLERS["en"])


@query("filler_penalty", f"SELECT doc_id, least(0.18::DOUBLE, 0.035::DOUBLE * ({_HITS})) AS penalty FROM documents WHERE text IS NOT NULL")
def filler_penalty(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", scripts.filler_penalty(F.col("text"), "en").alias("penalty"))


_DANGLING = "|".join(planning.DANGLING_ENDINGS)


@query("completeness", rf"""WITH p AS (SELECT conv_id, turn, lower(trim(CASE turn % 3 WHEN 0 THEN 'So ' || text ELSE text END)) AS a, lower(trim(CASE turn % 4 WHEN 0 THEN text || ' because' WHEN 1 THEN text || ' and.' ELSE text END)) AS b, turn % 2 + 1 AS n FROM conversations)
SELECT conv_id, turn, greatest(0.0::DOUBLE, 1 - CASE WHEN regexp_matches(a, '^(但是|然后|所以|and\b|but\b|so\b)') THEN 0.22::DOUBLE ELSE 0 END - CASE WHEN regexp_matches(b, '(?:{_DANGLING})[，,。.!！]?$') THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN n < 2 THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN regexp_matches(b, '[。！？.!?]$') THEN 0 ELSE 0.05::DOUBLE END) AS score FROM p""")
def completeness(spark, sf_dir):
    turn = F.col("turn")
    first = F.when(turn % 3 == 0, F.concat(F.lit("So "), "text")).otherwise(F.col("text"))
    last = F.when(turn % 4 == 0, F.concat("text", F.lit(" because"))).when(turn % 4 == 1, F.concat("text", F.lit(" and."))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", planning.completeness_score(first, last, turn % 2 + 1).alias("score"))


@query("internal_repeats", r"""WITH RECURSIVE t AS (SELECT conv_id, turn, regexp_extract_all(lower(text || ' and so and so ' || text), '[a-z]+') AS ts FROM conversations),
r AS (SELECT conv_id, turn, ts, -1 AS i, 0 AS k FROM t UNION ALL SELECT conv_id, turn, ts, i + CASE WHEN k > 0 THEN 2 * k ELSE 1 END,
 coalesce(list_max([s FOR s IN [1, 2, 3] IF i + CASE WHEN k > 0 THEN 2 * k ELSE 1 END + 2 * s <= len(ts) AND ts[i + CASE WHEN k > 0 THEN 2 * k ELSE 1 END + 1 : i + CASE WHEN k > 0 THEN 2 * k ELSE 1 END + s] = ts[i + CASE WHEN k > 0 THEN 2 * k ELSE 1 END + s + 1 : i + CASE WHEN k > 0 THEN 2 * k ELSE 1 END + 2 * s]]), 0) FROM r WHERE i < len(ts)),
f AS (SELECT conv_id, turn, ts, i, k FROM r WHERE k > 0)
SELECT conv_id, turn, CAST(i AS INTEGER) AS "at", array_to_string(ts[i + 1 : i + k], ' ') AS said FROM f""")
def internal_repeats(spark, sf_dir):
    text = F.concat("text", F.lit(" and so and so "), "text")
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens.alias("ts")).select("conv_id", "turn", F.inline(scripts.internal_repeats(F.col("ts"), 1, 3)))
    return rows.select("conv_id", "turn", "at", F.array_join("tokens", " ").alias("said"))


_PROBES = """p AS (SELECT user_id AS source, event_id::DOUBLE AS t, event_id * 0.0001::DOUBLE + CASE WHEN event_id % 5 = 0 THEN value / 10 ELSE (event_id % 7) / 100.0::DOUBLE END AS y FROM events WHERE value >= 0.9)"""


@query("drift_consensus", f"""WITH {_PROBES}, l AS (SELECT a.source, a.t AS lat, b.t AS rat, (b.y - a.y) / (b.t - a.t) AS s, a.y - (b.y - a.y) / (b.t - a.t) * a.t AS i FROM p a JOIN p b ON a.source = b.source AND a.t < b.t),
e AS (SELECT l.source, lat, rat, s, i, count(*) AS n, median(abs(y - i - s * t)) AS m FROM l JOIN p ON l.source = p.source AND abs(y - i - s * t) <= 0.08 GROUP BY ALL), b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, round(m, 9), round(abs(s), 12), lat, rat) = 1),
n AS (SELECT p.* FROM p JOIN b ON p.source = b.source AND abs(y - i - s * t) <= 0.08), f AS (SELECT source, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, count(*) AS inliers, max(t) - min(t) AS span FROM n GROUP BY source),
w AS (SELECT n.source, max(abs(y - slope * t - intercept)) AS worst FROM n JOIN f USING (source) GROUP BY n.source), c AS (SELECT source, count(*) AS probes FROM p GROUP BY source)
SELECT c.source, probes, inliers, slope, intercept, span, worst, CASE WHEN probes < 4 THEN 'too_few_confident_probes' WHEN inliers IS NULL THEN 'probe_times_not_distinct' WHEN inliers < 4 THEN 'too_few_consensus_inliers'
 ELSE concat_ws(',', CASE WHEN span < 500 THEN 'probe_span_too_short' END, CASE WHEN worst > 0.08 THEN 'fit_residual_too_large' END, CASE WHEN abs(slope) * 1e6 > 500 THEN 'drift_rate_implausible' END) END AS reasons FROM c LEFT JOIN f USING (source) LEFT JOIN w USING (source)""")
def drift_consensus(spark, sf_dir):
    i = F.col("event_id")
    offset = i * 0.0001 + F.when(i % 5 == 0, F.col("value") / 10).otherwise((i % 7) / 100)
    probes = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), i.cast("double").alias("at"), offset.alias("offset"), F.col("value").alias("confidence"))
    return scripts.drift_consensus(probes, ["source"], 0.9, 0.08, 500, 500)
