"""Queries over readers and sinks: logs and subtitles are made from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.plans.registry import query
from chronoweft.plans.timeline_queries import _EVENTS, edit_events
from chronoweft.plans.views import SEGMENTS, UNITS, segments, units
from chronoweft.sources import logs, sinks

_T = lambda c, p: f"printf('%02d:%02d:%02d{p}%03d', {c} // 3600000, ({c} // 60000) % 60, ({c} // 1000) % 60, {c} % 1000)"
_ORDERED = f"""{SEGMENTS}, o AS (SELECT source, start, "end", text, row_number() OVER (PARTITION BY source ORDER BY start, "end", text) AS n FROM s)"""


@query("srt_sink", f"""WITH {_ORDERED} SELECT source, string_agg(n || chr(10) || {_T("start", ",")} || ' --> ' || {_T('"end"', ",")} || chr(10) || text, chr(10) || chr(10) ORDER BY n) || chr(10) AS text FROM o GROUP BY source""")
def srt_sink(spark, sf_dir):
    return sinks.srt(segments(spark, sf_dir), ["source"])


@query("vtt_sink", f"""WITH {_ORDERED} SELECT source, 'WEBVTT' || chr(10) || chr(10) || string_agg({_T("start", ".")} || ' --> ' || {_T('"end"', ".")} || chr(10) || text, chr(10) || chr(10) ORDER BY n) || chr(10) AS text FROM o GROUP BY source""")
def vtt_sink(spark, sf_dir):
    return sinks.vtt(segments(spark, sf_dir), ["source"])


@query("ass_sink", f"""WITH {_ORDERED}, c AS (SELECT *, ((start + 5) // 10) * 10 AS a, (("end" + 5) // 10) * 10 AS b FROM o)
SELECT source, string_agg('Dialogue: 0,' || printf('%d:%02d:%02d.%02d', a // 3600000, (a // 60000) % 60, (a // 1000) % 60, (a % 1000) // 10) || ',' || printf('%d:%02d:%02d.%02d', b // 3600000, (b // 60000) % 60, (b // 1000) % 60, (b % 1000) // 10)
 || ',Default,,0,0,0,,' || replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '{{', chr(92) || '{{'), '}}', chr(92) || '}}'), chr(10), chr(92) || 'N'), chr(10) ORDER BY n) AS text FROM c GROUP BY source""")
def ass_sink(spark, sf_dir):
    return sinks.ass_events(segments(spark, sf_dir), ["source"])


@query("srt_round_trip", f"""WITH {SEGMENTS} SELECT source, start, "end" FROM s""")
def srt_round_trip(spark, sf_dir):
    return logs.srt_cues(srt_sink(spark, sf_dir), ["source"]).select("source", "start", "end")


@query("chapter_list", f"""WITH {SEGMENTS} SELECT source, string_agg(CASE WHEN start >= 3600000 THEN printf('%d:%02d:%02d', start // 3600000, (start // 60000) % 60, (start // 1000) % 60) ELSE (start // 60000) || ':' || printf('%02d', (start // 1000) % 60) END || ' ' || speaker, chr(10) ORDER BY start, speaker) AS text FROM s GROUP BY source""")
def chapter_list(spark, sf_dir):
    return sinks.chapters(segments(spark, sf_dir).select("source", "start", F.col("speaker").alias("title")), ["source"])


@query("timeline_json", f"""WITH {_EVENTS} SELECT source, '{{"kind":"Timeline","clips":[' || string_agg('{{"kind":"Clip","name":' || number || ',"source_range":{{"duration":{{"rate":25,"value":' || (source_out - source_in) || '}},"start_time":{{"rate":25,"value":' || source_in || '}}}}}}', ',' ORDER BY number) || ']}}' AS text FROM g GROUP BY source""")
def timeline_json(spark, sf_dir):
    return sinks.timeline_json(edit_events(spark, sf_dir), ["source"], 25)


@query("select_filter", f"""WITH {SEGMENTS} SELECT source, 'select=''' || string_agg(printf('between(t,%.3f,%.3f)', start / 1000::DOUBLE, "end" / 1000::DOUBLE), '+' ORDER BY start, "end") || '''' AS text FROM s GROUP BY source""")
def select_filter(spark, sf_dir):
    return sinks.select_filter(segments(spark, sf_dir), ["source"])


def _log_lines(spark, sf_dir):
    u = units(spark, sf_dir).filter("speaker = 'view'")
    both = F.array(F.concat(F.lit("[silencedetect] silence_start: "), (F.col("start") / 1000).cast("decimal(20,3)")), F.concat(F.lit("[silencedetect] silence_end: "), (F.col("end") / 1000).cast("decimal(20,3)"), F.lit(" | silence_duration: 1")))
    return u.select("source", F.col("id") * 2, F.posexplode(both).alias("k", "line")).select("source", (F.col("(id * 2)") + F.col("k")).alias("n"), "line")


@query("silence_log", f"""WITH {UNITS} SELECT source, start / 1000::DOUBLE AS start, "end" / 1000::DOUBLE AS "end" FROM u WHERE speaker = 'view' AND "end" > start""")
def silence_log(spark, sf_dir):
    lines = _log_lines(spark, sf_dir)
    lengths = lines.select("source").distinct().withColumn("duration", F.lit(1e10))
    return logs.detected_spans(lines, lengths, ["source"], "silence_start", "silence_end")


@query("rttm_reader", f"""WITH {UNITS} SELECT source, start / 1000::DOUBLE AS start, start / 1000::DOUBLE + ("end" - start) / 1000::DOUBLE AS "end", speaker FROM u WHERE "end" > start""")
def rttm_reader(spark, sf_dir):
    ms = lambda c: (c / 1000).cast("decimal(20,3)").cast("string")
    line = F.concat_ws(" ", F.lit("SPEAKER file 1"), ms(F.col("start")), ms(F.col("end") - F.col("start")), F.lit("<NA> <NA>"), F.col("speaker"), F.lit("<NA> <NA>"))
    return logs.rttm(units(spark, sf_dir).select("source", line.alias("line")), ["source"])
