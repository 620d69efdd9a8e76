"""Queries over readers of logs and small column functions: logs are made from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.functions import geometry, selectors, timecode
from chronoweft.functions import text as T
from chronoweft.operators import ledger, similarity, validation
from chronoweft.plans.registry import query
from chronoweft.plans.views import UNITS, table, units
from chronoweft.sources import commands, logs


def _seconds(c):
    return F.format_string("%.3f", c / 1000)


@query("black_spans", f"""WITH {UNITS} SELECT id, printf('%.3f', start / 1000.0::DOUBLE)::DOUBLE AS start, printf('%.3f', "end" / 1000.0::DOUBLE)::DOUBLE AS "end", printf('%.3f', ("end" - start) / 1000.0::DOUBLE)::DOUBLE AS duration FROM u UNION ALL SELECT id, 1.5, 2, 0.5 FROM u""")
def black_spans(spark, sf_dir):
    line = F.concat(F.lit("[blackdetect @ 0x1] black_start:"), _seconds(F.col("start")), F.lit(" black_end:"), _seconds(F.col("end")), F.lit(" black_duration:"), _seconds(F.col("end") - F.col("start")), F.lit("\n[blackdetect @ 0x1] black_start:1.5 black_end:2 black_duration:0.5\n"))
    return units(spark, sf_dir).select("id", F.inline(logs.black_spans(line)))


@query("scene_times", f"""WITH {UNITS}, t AS (SELECT source, start % 100000 AS t FROM u) SELECT source, array_to_string(list_transform(list_sort(list_distinct(list(t))), lambda x: x::BIGINT), ',') AS times FROM t GROUP BY source""")
def scene_times(spark, sf_dir):
    """Times in ms; some occur twice."""
    at = F.concat(F.lit("n:1 pts_time:"), _seconds(F.col("start") % 100_000), F.lit(" pos:7"))
    texts = units(spark, sf_dir).groupBy("source").agg(F.concat_ws("\n", F.collect_list(at)).alias("log"))
    return texts.select("source", F.array_join(F.transform(logs.scene_times(F.col("log")), lambda t: F.round(t * 1000).cast("long").cast("string")), ",").alias("times"))


_LINES = f"""{UNITS}, f AS (SELECT source, id, (start // 1000) AS t, id % 7 AS score, id % 5 AS y FROM u)"""


def _frames(spark, sf_dir):
    i = F.col("id")
    texts = F.array(
        F.concat(F.lit("frame:1 pts_time:"), F.floor(F.col("start") / 1000).cast("string")),
        F.concat(F.lit("lavfi.scene_score=0."), (i % 7).cast("string")),
        F.concat(F.lit("lavfi.signalstats.YAVG="), (i % 5).cast("string")),
        F.when(i % 3 > 0, F.concat(F.lit("lavfi.signalstats.SATAVG="), i.cast("string"))).otherwise("nothing here"),
    )
    return units(spark, sf_dir).select("source", "id", F.posexplode(texts).alias("k", "line")).select("source", (F.col("id") * 10 + F.col("k")).alias("n"), "line")


@query("scene_scores", f"""WITH {_LINES} SELECT source, t::DOUBLE AS time, max(score) / 10.0::DOUBLE AS score FROM f GROUP BY source, t""")
def scene_scores(spark, sf_dir):
    return logs.scene_scores(_frames(spark, sf_dir), ["source"])


@query("frame_values", f"""WITH {_LINES} SELECT source, t::DOUBLE AS time, max(y)::DOUBLE AS "YAVG", max(CASE WHEN id % 3 > 0 THEN id END)::DOUBLE AS "SATAVG" FROM f GROUP BY source, t HAVING max(CASE WHEN id % 3 > 0 THEN id END) IS NOT NULL""")
def frame_values(spark, sf_dir):
    return logs.frame_values(_frames(spark, sf_dir), ["source"], ["YAVG", "SATAVG"])


@query("loudness_summaries", """SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN -p_size - 0.5::DOUBLE END AS integrated, p_size / 2.0::DOUBLE AS range, CASE WHEN p_size % 3 > 0 THEN -1.5::DOUBLE END AS peak FROM part""")
def loudness_summaries(spark, sf_dir):
    size = F.col("p_size")
    log = F.concat(F.lit("I: -70.0 LUFS\nSummary:\n"), F.when(size % 4 > 0, F.format_string("  I:         %.1f LUFS\n", -size - 0.5)).otherwise("  I: nan\n"), F.format_string("  LRA:       %.1f LU\n", size / 2), F.when(size % 3 > 0, "    Peak:       -1.5 dBFS\n").otherwise(""))
    log = F.when(size % 4 > 0, log).otherwise(F.replace(log, F.lit("I: -70.0 LUFS\n"), F.lit("")))
    return table(spark, sf_dir, "part").select("p_partkey", logs.loudness(log).alias("l")).select("p_partkey", "l.*")


@query("noise_thresholds", """SELECT p_partkey, least(-25.0, greatest(-60.0, CASE WHEN p_size % 4 > 0 THEN -20.5 - p_size ELSE -42.0 END))::DOUBLE AS threshold FROM part""")
def noise_thresholds(spark, sf_dir):
    size = F.col("p_size")
    log = F.when(size % 4 > 0, F.concat(F.lit('{"input_thresh" : "-10.0"}\n{"input_i":"-1", "input_thresh" : "'), F.format_string("%.1f", -20.5 - size), F.lit('"}'))).otherwise("nothing")
    return table(spark, sf_dir, "part").select("p_partkey", logs.noise_threshold(log, -42.0).alias("threshold"))


@query("nested_units", """WITH t AS (SELECT conv_id, turn, role, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM conversations), w AS (SELECT conv_id, turn AS segment, generate_subscripts(ws, 1) - 1 AS k, unnest(ws) AS text, role FROM t WHERE turn % 3 > 0 AND len(ws) > 0)
SELECT conv_id, segment, CAST(k AS INTEGER) AS k, CASE WHEN k % 2 = 0 THEN segment * 10 + k / 10.0::DOUBLE ELSE segment * 10.0::DOUBLE END AS start, CASE WHEN k % 2 = 0 THEN segment * 10 + 1 + k / 10.0::DOUBLE ELSE segment * 10 + 9.0::DOUBLE END AS "end", text, role AS speaker FROM w WHERE k % 5 <> 4
UNION ALL SELECT conv_id, turn, 0, turn * 10.0::DOUBLE, turn * 10 + 9.0::DOUBLE, text, role FROM t WHERE turn % 3 = 0 OR len(ws) = 0""")
def nested_units(spark, sf_dir):
    """A third of the segments have no words; odd words have no times, every fifth is spacing."""
    turn = F.col("turn")
    timed = lambda k, at: F.when(k % 2 == 0, turn * 10 + at + k / 10)
    words = F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), lambda w, k: F.struct(w.alias("word"), timed(k, 0).cast("double").alias("start"), timed(k, 1).cast("double").alias("end"), F.lit(None).cast("string").alias("speaker"), F.when(k % 5 == 4, "spacing").otherwise("word").alias("type")))
    segment = F.struct(turn.alias("id"), (turn * 10).cast("double").alias("start"), (turn * 10 + 9).cast("double").alias("end"), "text", F.col("role").alias("speaker"), F.when(turn % 3 > 0, words).alias("words"))
    return logs.transcript_units(table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(segment).alias("segments")), ["conv_id"])


@query("crops", """WITH b AS (SELECT vec_id, 200 + vec_id % 1700 AS w, 300 + vec_id % 900 AS h, abs(embedding[1]::DOUBLE) * 1000 AS f FROM embeddings), c AS (SELECT *, CAST(floor((CASE WHEN w / h::DOUBLE > 9 / 16.0::DOUBLE THEN h * (9 / 16.0::DOUBLE) ELSE w END) / 2) * 2 AS BIGINT) AS cw, CAST(floor((CASE WHEN w / h::DOUBLE > 9 / 16.0::DOUBLE THEN h ELSE w / (9 / 16.0::DOUBLE) END) / 2) * 2 AS BIGINT) AS ch FROM b)
SELECT vec_id, cw AS w, ch AS h, CAST(greatest(0, least(round_even(f - cw / 2.0::DOUBLE, 0), w - cw)) AS BIGINT) AS x FROM c""")
def crops(spark, sf_dir):
    w, h = (F.col("vec_id") % 1700 + 200), (F.col("vec_id") % 900 + 300)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", w.alias("width"), (F.abs(F.col("embedding")[0].cast("double")) * 1000).alias("f"), geometry.crop_to_aspect(w, h, 9 / 16).alias("c"))
    return rows.select("vec_id", "c.w", "c.h", geometry.crop_origin(F.col("f"), F.col("width"), F.col("c.w")).alias("x"))


@query("breaches", """WITH b AS (SELECT vec_id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y FROM embeddings) SELECT vec_id, concat_ws(',', CASE WHEN x < 60 THEN 'left' END, CASE WHEN y < 210 THEN 'top' END, CASE WHEN x + 300 > 400 THEN 'right' END, CASE WHEN y + 100 > 480 THEN 'bottom' END, CASE WHEN x < 0 OR y < 0 OR x + 300 > 500 OR y + 100 > 500 THEN 'canvas' END) AS sides FROM b""")
def breaches(spark, sf_dir):
    x, y = (F.col("embedding")[k].cast("double") * 1000 for k in (0, 1))
    own, safe = geometry.box(x, y, x + 300, y + 100), geometry.box(*(F.lit(float(v)) for v in (60, 210, 400, 480)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(geometry.breaches(own, safe, 500, 500), ",").alias("sides"))


@query("aspects", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size / 16.0::DOUBLE WHEN 1 THEN p_size / 10.0::DOUBLE WHEN 2 THEN NULL ELSE 1.78 END AS ratio FROM part""")
def aspects(spark, sf_dir):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 4 == 0, F.concat(size, F.lit(":16"))).when(F.col("p_size") % 4 == 1, F.concat(size, F.lit("x10"))).when(F.col("p_size") % 4 == 2, F.concat(size, F.lit(":0"))).otherwise("1.78")
    return table(spark, sf_dir, "part").select("p_partkey", geometry.parse_aspect(text).alias("ratio"))


@query("reconciled_ranges", """WITH r AS (SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_size::DOUBLE END AS s, CASE WHEN p_size % 4 > 0 THEN p_size + 5.0::DOUBLE END AS e, CASE WHEN p_size % 5 > 0 THEN 30.0::DOUBLE END AS d FROM part), f AS (SELECT p_partkey, coalesce(s, e - d) AS s, coalesce(e, s + d) AS e FROM r) SELECT p_partkey, CASE WHEN s >= 0 AND e >= s THEN s END AS start, CASE WHEN s >= 0 AND e >= s THEN e END AS "end" FROM f""")
def reconciled_ranges(spark, sf_dir):
    size = F.col("p_size")
    found = selectors.reconciled_range(F.when(size % 3 > 0, size.cast("double")), F.when(size % 4 > 0, size + 5.0), F.when(size % 5 > 0, 30.0))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("r")).select("p_partkey", "r.start", "r.end")


@query("time_values", f"""WITH {UNITS}, d AS (SELECT id, "end" - start AS ms FROM u) SELECT id, CASE WHEN ms > 10000 THEN ms / 1000000.0::DOUBLE ELSE ms END AS seconds, CASE WHEN round_even(ms / 1000.0::DOUBLE * 25, 0) = 0 THEN '0s' ELSE CAST(round_even(ms / 1000.0::DOUBLE * 25, 0) AS BIGINT) || '/25s' END AS rational FROM d""")
def time_values(spark, sf_dir):
    u = units(spark, sf_dir).select("id", (F.col("end") - F.col("start")).alias("ms"))
    return u.select("id", selectors.seconds_of_range(F.col("ms").cast("double")).alias("seconds"), timecode.rational_time(F.col("ms") / 1000, 25).alias("rational"))


@query("canonical_names", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'done' WHEN p_size % 3 = 1 THEN 'failed' ELSE 'unknown' END AS status, CASE WHEN p_size % 2 = 0 THEN 'pexels' WHEN p_size % 5 = 0 THEN 'pixabay' ELSE 'unknown' END AS provider FROM part""")
def canonical_names(spark, sf_dir):
    size = F.col("p_size")
    told = F.when(size % 3 == 0, " Succeeded ").when(size % 3 == 1, "ERROR").otherwise("what")
    url = F.when(size % 2 == 0, "https://Images.PEXELS.com/1").when(size % 5 == 0, "http://cdn.pixabay.com/x")
    return table(spark, sf_dir, "part").select("p_partkey", ledger.alias(told, {"succeeded": "done", "error": "failed"}).alias("status"), selectors.host_provider(url, ["pexels", "pixabay"]).alias("provider"))


@query("term_lists", """WITH l AS (SELECT p_partkey, list_filter([trim(x) FOR x IN regexp_split_to_array(p_name || ', ' || upper(p_name) || '；' || p_brand || ';;' || p_type || '、' || lower(p_brand), '[,;，；、\n]+')], lambda x: x <> '') AS l FROM part) SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position([lower(y) FOR y IN l], lower(x)) = i), '|') AS terms FROM l""")
def term_lists(spark, sf_dir):
    text = F.concat("p_name", F.lit(", "), F.upper("p_name"), F.lit("；"), "p_brand", F.lit(";;"), "p_type", F.lit("、"), F.lower("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.ordered_terms(text), "|").alias("terms"))


@query("boundary_distances", f"""WITH {UNITS}, x AS (SELECT source, id, start AS t FROM u WHERE speaker = 'view'), y AS (SELECT source, id, start AS t FROM u WHERE speaker <> 'view'),
m AS (SELECT x.source, min(abs(x.t - y.t)) AS d FROM x JOIN y USING (source) GROUP BY x.source, x.id UNION ALL SELECT y.source, min(abs(x.t - y.t)) FROM y JOIN x USING (source) GROUP BY y.source, y.id) SELECT source, avg(d)::DOUBLE AS distance FROM m GROUP BY source""")
def boundary_distances(spark, sf_dir):
    u = units(spark, sf_dir).select("source", F.col("start").alias("at"), "speaker")
    return similarity.mean_nearest_distance(u.filter("speaker = 'view'").drop("speaker"), u.filter("speaker <> 'view'").drop("speaker"), ["source"])


@query("video_bitrates", """SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN CAST(floor(p_size * 1000000.0::DOUBLE * 8 * 0.95::DOUBLE / (p_size % 4 * 10)) - 128000 AS BIGINT) END AS bps FROM part""")
def video_bitrates(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", validation.bitrate(size * 1_000_000, size % 4 * 10, 128_000).alias("bps"))


@query("box_filters", """WITH b AS (SELECT label, vec_id, CAST(abs(embedding[1]::DOUBLE) * 1000 AS BIGINT) AS x, CAST(abs(embedding[2]::DOUBLE) * 1000 AS BIGINT) AS y FROM embeddings)
SELECT label, string_agg('drawbox=x=' || x || ':y=' || y || ':w=40:h=30:t=fill:enable=''between(t,' || printf('%.3f', vec_id::DOUBLE) || ',' || printf('%.3f', vec_id + 1.5::DOUBLE) || ')''', ',' ORDER BY vec_id) AS text FROM b GROUP BY label""")
def box_filters(spark, sf_dir):
    x, y = (F.round(F.abs(F.col("embedding")[k].cast("double")) * 1000).cast("long") for k in (0, 1))
    rows = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") * 1000).alias("start"), (F.col("vec_id") * 1000 + 1500).alias("end"), x.alias("x1"), y.alias("y1"), (x + 40).alias("x2"), (y + 30).alias("y2"))
    return commands.box_filters(rows, ["label"])
