"""Queries over output timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.operators import timeline
from chronoweft.plans.registry import query
from chronoweft.plans.views import SEGMENTS, segments

_EVENTS = f"""{SEGMENTS}, f AS (SELECT source, id, CAST(round_even(start / 1000::DOUBLE * 25, 0) AS BIGINT) AS a, CAST(round_even("end" / 1000::DOUBLE * 25, 0) AS BIGINT) AS b FROM s),
g AS (SELECT source, CAST(row_number() OVER w AS INTEGER) AS number, a AS source_in, b AS source_out, CAST(coalesce(sum(b - a) OVER (PARTITION BY source ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_in,
 CAST(sum(b - a) OVER w AS BIGINT) AS record_out FROM f WHERE b > a WINDOW w AS (PARTITION BY source ORDER BY id))"""


@query("edit_events", f"WITH {_EVENTS} SELECT * FROM g")
def edit_events(spark, sf_dir):
    return timeline.edit_events(segments(spark, sf_dir), ["source"], ["id"])


def _tc(c: str) -> str:
    return f"printf('%02d:%02d:%02d:%02d', {c} // 90000, ({c} // 1500) % 60, ({c} // 25) % 60, {c} % 25)"


@query("edit_list_lines", f"""WITH {_EVENTS} SELECT source, number, printf('%03d', number) || ' ' || rpad('CONV' || source, 8, ' ') || ' V     C        ' || {_tc("source_in")} || ' ' || {_tc("source_out")} || ' ' || {_tc("record_in")} || ' ' || {_tc("record_out")} AS line FROM g""")
def edit_list_lines(spark, sf_dir):
    reel = timeline.reel_name(F.concat(F.lit("media/conv_"), F.col("source"), F.lit(".mp4")))
    return timeline.edit_list_lines(edit_events(spark, sf_dir), reel).select("source", "number", "line")


@query("output_times", f"""WITH {SEGMENTS} SELECT source, id, CAST(floor(coalesce(sum(("end" - start) / 1.25::DOUBLE) OVER (PARTITION BY source ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) + 500 AS out_start,
 CAST(floor(sum(("end" - start) / 1.25::DOUBLE) OVER (PARTITION BY source ORDER BY id)) AS BIGINT) + 500 AS out_end FROM s""")
def output_times(spark, sf_dir):
    return timeline.output_times(segments(spark, sf_dir), ["source"], ["id"], F.lit(1.25), 500).select("source", "id", "out_start", "out_end")


@query("speed_ramp", f"""WITH {SEGMENTS}, k AS (SELECT source, id, start, "end", CASE id % 4 WHEN 0 THEN 'linear' WHEN 1 THEN 'ease' WHEN 2 THEN 's_curve' ELSE 'snap' END AS curve, unnest(range(0, 4)) AS step FROM s),
p AS (SELECT source, id, CAST(step AS INTEGER) AS step, start + ("end" - start) / 4 * step AS piece_start, start + ("end" - start) / 4 * (step + 1) AS piece_end, (step + 0.5::DOUBLE) / 4 AS m, curve FROM k),
q AS (SELECT *, 1.0::DOUBLE + CASE curve WHEN 'ease' THEN (1 - cos(m * pi())) / 2 WHEN 's_curve' THEN m * m * (3 - 2 * m) WHEN 'snap' THEN CASE WHEN m < 0.5 THEN 0 ELSE 1 END ELSE m END AS speed FROM p)
SELECT source, id, step, piece_start, piece_end, speed, coalesce(sum((piece_end - piece_start) / speed) OVER (PARTITION BY source, id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS out_start FROM q""")
def speed_ramp(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("linear", "ease", "s_curve", "snap"))), (F.col("id") % 4 + 1).cast("int"))
    ramps = segments(spark, sf_dir).select("source", "id", "start", "end", F.lit(1.0).alias("from_speed"), F.lit(2.0).alias("to_speed"), kind.alias("curve"))
    return timeline.ramp_pieces(ramps, ["source", "id"], 4)


@query("proportional_cues", f"""WITH {SEGMENTS}, p AS (SELECT source, id, start, "end", unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM s),
n AS (SELECT *, greatest(length(part), 1) AS n FROM p), t AS (SELECT *, sum(n) OVER (PARTITION BY source, id) AS total, coalesce(sum(n) OVER (PARTITION BY source, id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
 max(k) OVER (PARTITION BY source, id) AS last FROM n)
SELECT source, id, CAST(k AS INTEGER) AS k, start + CAST(floor(("end" - start) * b / total) AS BIGINT) AS cue_start, CASE WHEN k = last THEN "end" ELSE start + CAST(floor(("end" - start) * (b + n) / total) AS BIGINT) END AS cue_end FROM t""")
def proportional_cues(spark, sf_dir):
    parts = segments(spark, sf_dir).select("source", "id", "start", "end", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    return timeline.proportional_cues(parts, ["source", "id"], ["k"]).select("source", "id", "k", "cue_start", "cue_end")


@query("neighbour_context", """SELECT conv_id AS source, turn AS id, array_to_string(list_concat([], coalesce(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), [])), ',') AS before,
 array_to_string(coalesce(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), []), ',') AS after FROM conversations""")
def neighbour_context(spark, sf_dir):
    near = timeline.neighbours(segments(spark, sf_dir), ["source"], ["id"], "speaker", 2)
    return near.select("source", "id", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


@query("equal_groups", """SELECT conv_id AS source, turn AS id, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) * least(count(*) OVER (PARTITION BY conv_id), 3) // count(*) OVER (PARTITION BY conv_id) AS INTEGER) AS "group" FROM conversations""")
def equal_groups(spark, sf_dir):
    return timeline.equal_groups(segments(spark, sf_dir), ["source"], ["id"], 3).select("source", "id", "group")


@query("audio_handles", f"""WITH {SEGMENTS}, h AS (SELECT source, id, start, "end", lag(("end" - start) // 2) OVER w AS p, lead(("end" - start) // 2) OVER w AS n FROM s WINDOW w AS (PARTITION BY source ORDER BY id))
SELECT source, id, start - coalesce(least(p, 400), 0) AS audio_start, "end" + coalesce(least(n, 600), 0) AS audio_end FROM h""")
def audio_handles(spark, sf_dir):
    clips = segments(spark, sf_dir).select("source", "id", F.col("start").alias("out_start"), F.col("end").alias("out_end"))
    return timeline.audio_handles(clips, ["source"], ["id"], 400, 600).select("source", "id", "audio_start", "audio_end")
