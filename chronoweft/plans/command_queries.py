"""Queries over filter expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.plans.registry import query
from chronoweft.plans.views import SEGMENTS, segments, table
from chronoweft.sources import commands

_PLAIN = lambda c: f"regexp_replace(regexp_replace(printf('%.6f', ({c})::DOUBLE), '0+$', ''), '\\.$', '')"


@query("speech_filters", f"""WITH s AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS speed, p_size % 2 = 0 AS loud, CASE WHEN p_size % 3 = 0 THEN p_size * 10 ELSE 0 END AS cover FROM part),
t AS (SELECT *, CASE WHEN speed > 4 THEN 2 WHEN speed > 2 THEN 1 ELSE 0 END AS n FROM s)
SELECT p_partkey, concat_ws(',', 'highpass=f=80', CASE WHEN speed <> 1 THEN repeat('atempo=2.0,', n) || 'atempo=' || printf('%.4f', speed / power(2, n)) END, CASE WHEN loud THEN '{",".join(commands.SPEECH_DYNAMICS)}' END, CASE WHEN cover > 0 THEN 'adelay=' || cover || ':all=1' END) AS filters FROM t""")
def speech_filters(spark, sf_dir):
    size = F.col("p_size")
    line = commands.speech_filters(size / 10, size % 2 == 0, F.when(size % 3 == 0, size * 10).otherwise(0), ["highpass=f=80"])
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("filters"))


_FMT = commands.MUSIC_FORMAT


@query("music_filters", f"""WITH m AS (SELECT p_partkey, '[' || p_size % 4 || ':a]aloop=loop=-1:size=2147483647,atrim=duration=' || printf('%.4f', p_size * 1.5::DOUBLE) || ',asetpts=PTS-STARTPTS,volume=0.25' || CASE WHEN p_size % 3 > 0 THEN ',afade=t=out:st=' || printf('%.4f', greatest(0, p_size * 1.5::DOUBLE - 4)) || ':d=4.0000' ELSE '' END AS l, p_size % 2 = 0 AS ducked FROM part)
SELECT p_partkey, l || CASE WHEN ducked THEN ',{_FMT}[bgm_a];[voice]{_FMT},asplit=2[voice_mix][voice_sc];[bgm_a][voice_sc]sidechaincompress=threshold=0.03:ratio=8:attack=20:release=300:knee=2.82843:detection=rms:level_sc=1[bgm_ducked];[voice_mix][bgm_ducked]amix=inputs=2:duration=first:dropout_transition=0:normalize=0,alimiter=limit=0.95:level=false[final_a]'
 ELSE '[bgm_a];[voice][bgm_a]amix=inputs=2:duration=first:dropout_transition=0[final_a]' END AS filters FROM m""")
def music_filters(spark, sf_dir):
    size = F.col("p_size")
    line = commands.music_filters((size % 4).cast("int"), size * 1.5, F.lit(0.25), F.when(size % 3 > 0, 4.0).otherwise(0.0), size % 2 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("filters"))


@query("proxy_filters", f"""WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_size % 3 = 0 THEN '  ' ELSE ' Take 1: 50% ' || p_brand END AS label FROM part)
SELECT p_partkey, concat_ws(',', 'scale=-2:''min(ih,' || p_size * 10 || ')'':flags=lanczos', 'fps=' || {_PLAIN("p_size / 2.0")}, CASE WHEN trim(label) <> '' THEN 'drawtext=text=''' || replace(replace(trim(label), ':', '\\:'), '%', '\\%') || ''':fontcolor=white:fontsize=h/30:box=1:boxcolor=black@0.68:boxborderw=10:x=20:y=20' END,
 CASE WHEN p_size % 2 = 0 THEN 'drawtext=text=''%{{pts\\:hms}}'':fontcolor=white:fontsize=h/30:box=1:boxcolor=black@0.68:boxborderw=10:x=20:y=' || CASE WHEN trim(label) <> '' THEN '20+h/30+18' ELSE '20' END END) AS filters FROM p""")
def proxy_filters(spark, sf_dir):
    size = F.col("p_size")
    label = F.when(size % 3 == 0, "  ").otherwise(F.concat(F.lit(" Take 1: 50% "), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", commands.proxy_filter(size * 10, size / 2, label, size % 2 == 0).alias("filters"))


@query("stabilising_filters", """SELECT p_partkey, 'vidstabtransform=input=t' || p_partkey || '.trf:smoothing=' || p_size || ':optzoom=1:crop=black' || CASE WHEN p_size % 4 > 0 THEN ',unsharp=5:5:' || printf('%.3f', (p_size % 4) / 8.0::DOUBLE) || ':3:3:0' ELSE '' END AS filters FROM part""")
def stabilising_filters(spark, sf_dir):
    size = F.col("p_size")
    transforms = F.concat(F.lit("t"), F.col("p_partkey").cast("string"), F.lit(".trf"))
    return table(spark, sf_dir, "part").select("p_partkey", commands.stabilising_filter(size, F.lit(1), F.lit("black"), (size % 4) / 8, transforms).alias("filters"))


_CHAPTERS = f"""{SEGMENTS}, n AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY start, id) AS number, start, "end", max("end") OVER (PARTITION BY source) AS d FROM s), c AS (SELECT * FROM n WHERE d > 0)"""


def _chapters(spark, sf_dir):
    from pyspark.sql import Window

    s = segments(spark, sf_dir)
    numbered = s.select("source", F.row_number().over(Window.partitionBy("source").orderBy("start", "id")).alias("number"), "start", "end")
    return numbered, s.groupBy("source").agg(F.max("end").alias("duration")).filter("duration > 0")


@query("chapter_bars", f"""WITH {_CHAPTERS}, p AS (SELECT source, d, string_agg('drawbox=x=iw*' || printf('%.6f', start / d::DOUBLE) || ':y=57:w=iw*' || printf('%.6f', ("end" - start) / d::DOUBLE) || ':h=16:color=' || ['red', 'blue', 'green'][(number - 1) % 3 + 1] || '@0.85:t=fill', ',' ORDER BY number) AS parts,
 string_agg(CASE WHEN number > 1 THEN 'drawbox=x=iw*' || printf('%.6f', start / d::DOUBLE) || '-1:y=57:w=2:h=16:color=white@0.9:t=fill' END, ',' ORDER BY number) AS lines FROM c GROUP BY source, d)
SELECT source, concat_ws(',', 'drawbox=x=0:y=57:w=iw:h=16:color=black@0.5:t=fill', parts, lines, 'drawbox=x=0:y=57:w=''iw*t/' || printf('%.4f', d / 1000::DOUBLE) || ''':h=16:color=white@0.35:t=fill,drawbox=x=''iw*t/' || printf('%.4f', d / 1000::DOUBLE) || '-2'':y=56:w=5:h=18:color=white@0.95:t=fill') AS text FROM p""")
def chapter_bars(spark, sf_dir):
    rows, lengths = _chapters(spark, sf_dir)
    return commands.chapter_bar(rows, lengths, ["source"], 1080, 1920, ["red", "blue", "green"])


@query("angle_grids", f"""WITH {_CHAPTERS}, k AS (SELECT source, number - 1 AS n FROM c)
SELECT source, string_agg('[' || n || ':v:0]scale=480:270:force_original_aspect_ratio=decrease,pad=480:270:(ow-iw)/2:(oh-ih)/2:black,setsar=1,setpts=PTS-STARTPTS[v' || n || ']', ';' ORDER BY n) || ';' || string_agg('[v' || n || ']', '' ORDER BY n) || 'xstack=inputs=' || count(*) || ':layout=' || string_agg((n % 2) * 480 || '_' || (n // 2) * 270, '|' ORDER BY n) || ':fill=black[vout]' AS text FROM k GROUP BY source""")
def angle_grids(spark, sf_dir):
    rows, lengths = _chapters(spark, sf_dir)
    return commands.angle_grid(rows.join(lengths, "source").select("source", (F.col("number") - 1).alias("number")), ["source"])
