"""Queries over hooks, titles, jobs and checklists."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.operators import publishing
from chronoweft.plans.registry import query
from chronoweft.plans.text_queries import _GUARD
from chronoweft.plans.views import UNITS, table, units


@query("contrast_pairs", r"""WITH p AS (SELECT conv_id, turn, role, CASE turn % 4 WHEN 0 THEN text || '从早上到晚上的' || text WHEN 1 THEN '以前' || text || '现在' WHEN 2 THEN text || ' and After all' ELSE text END AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '从(.{1,8})到(.{1,8})') THEN substr(trim(regexp_extract(t, '从(.{1,8})到(.{1,8})', 1)), 1, 5) WHEN contains(t, '以前') AND contains(t, '现在') THEN '以前' WHEN regexp_matches(t, '(?i)\b(before|after)\b') THEN 'before' ELSE role END AS before,
 CASE WHEN regexp_matches(t, '从(.{1,8})到(.{1,8})') THEN substr(trim(regexp_extract(t, '从(.{1,8})到(.{1,8})', 2)), 1, 5) WHEN contains(t, '以前') AND contains(t, '现在') THEN '现在' WHEN regexp_matches(t, '(?i)\b(before|after)\b') THEN 'after' ELSE '结果' END AS after FROM p""")
def contrast_pairs(spark, sf_dir):
    turn = F.col("turn") % 4
    text = F.when(turn == 0, F.concat("text", F.lit("从早上到晚上的"), "text")).when(turn == 1, F.concat(F.lit("以前"), "text", F.lit("现在"))).when(turn == 2, F.concat("text", F.lit(" and After all"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", publishing.contrast_pair(text, F.col("role")).alias("p")).select("conv_id", "turn", "p.before", "p.after")


_FAMILIES = [publishing.HookFamily("number", "{number} facts about {topic}", 0.7, r"\d", 0.06), publishing.HookFamily("proof", "{proof} proves it: {topic}", 0.66, "the|und"), publishing.HookFamily("lens", "vx {persona}", 0.5)]


def _hook_sql(k: int, f: publishing.HookFamily, line: str, tight: str) -> str:
    made = f"CASE WHEN length({line}) <= 30 THEN {line} WHEN length({tight}) <= 30 THEN {tight} ELSE substr({tight}, 1, 30) END"
    evident = f"regexp_matches(text, '(?i){f.evidence}')" if f.evidence else "FALSE"
    return f"SELECT p_partkey, {k} AS number, '{f.name}' AS family, {made} AS hook, least(0.98, {f.score} + CASE WHEN {evident} THEN {f.bonus} ELSE 0 END)::DOUBLE AS s FROM p"


_CUT = lambda c: f"substr({c}, 1, 12)"
_HOOKS = " UNION ALL ".join(
    [
        _hook_sql(1, _FAMILIES[0], "p_size || ' facts about ' || p_name", f"p_size || ' facts about ' || {_CUT('p_name')}"),
        _hook_sql(2, _FAMILIES[1], "p_brand || ' proves it: ' || p_name", f"{_CUT('p_brand')} || ' proves it: ' || {_CUT('p_name')}"),
        _hook_sql(3, _FAMILIES[2], "'vx ' || p_type", f"'vx ' || {_CUT('p_type')}"),
    ]
)


@query("hook_variants", f"""WITH p AS (SELECT *, p_name || ' ' || p_type AS text FROM part), h AS ({_HOOKS}), g AS (SELECT *, CASE WHEN regexp_matches(hook, '(?i){_GUARD}') THEN 'blocked' WHEN length(hook) > 27 THEN 'review' ELSE 'ready' END AS status FROM h)
SELECT p_partkey, number, family, hook, status, round(greatest(0.0, least(1.0, s - CASE status WHEN 'blocked' THEN 0.3 WHEN 'review' THEN 0.08 ELSE 0 END)), 3) AS score FROM g""")
def hook_variants(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("text", F.concat_ws(" ", "p_name", "p_type"))
    slots = {"number": F.col("p_size").cast("string"), "topic": F.col("p_name"), "proof": F.col("p_brand"), "persona": F.col("p_type")}
    return publishing.hook_variants(p, ["p_partkey"], _FAMILIES, slots, 30)


@query("caption_titles", """WITH p AS (SELECT conv_id, turn, trim(CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN substr(text, 1, 12) ELSE text END) AS h, CASE turn % 3 WHEN 0 THEN [role, 'b'] WHEN 1 THEN [role] ELSE []::VARCHAR[] END AS k FROM conversations), c AS (SELECT *, substr(h, 1, 18) AS c FROM p),
m AS (SELECT *, list_filter([length(c) - strpos(reverse(c), x) FOR x IN ['？', '！', '。', '，', '、', ' '] IF contains(c, x)], lambda i: i >= 4) AS ends FROM c)
SELECT conv_id, turn, CASE WHEN length(h) BETWEEN 4 AND 18 THEN h WHEN length(h) > 18 THEN CASE WHEN len(ends) > 0 THEN substr(c, 1, ends[1]) ELSE c END WHEN len(k) >= 2 THEN CASE WHEN length(k[1] || k[2] || '：3个值得知道的事') <= 18 THEN k[1] || k[2] || '：3个值得知道的事' ELSE k[1] || k[2] || '：值得收藏' END WHEN len(k) = 1 THEN k[1] || '：值得收藏' ELSE '今日分享' END AS title FROM m""")
def caption_titles(spark, sf_dir):
    turn = F.col("turn")
    told = F.when(turn % 4 == 0, "").when(turn % 4 == 1, F.substring("text", 1, 12)).otherwise(F.col("text"))
    keywords = F.when(turn % 3 == 0, F.array(F.col("role"), F.lit("b"))).when(turn % 3 == 1, F.array(F.col("role"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", publishing.caption_title(told, keywords).alias("title"))


@query("short_jobs", f"""WITH {UNITS}, r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY start, id) AS rank, start % 10000000 AS start, start % 10000000 + "end" - start AS "end", id % 100 AS score FROM u)
SELECT source, 'short_' || lpad(rank::VARCHAR, greatest(2, length(rank::VARCHAR))::INTEGER, '0') AS job, CASE WHEN source % 5 > 0 THEN 'planned' ELSE 'blocked' END AS status, CAST(rank AS INTEGER) AS rank, score, round(start / 1000.0::DOUBLE, 3) AS start, round("end" / 1000.0::DOUBLE, 3) AS "end", round(("end" - start) / 1000.0::DOUBLE, 3) AS duration,
 'python3 render_final.py --config work/short_' || lpad(rank::VARCHAR, greatest(2, length(rank::VARCHAR))::INTEGER, '0') || '_render_config.json --output output/short_' || lpad(rank::VARCHAR, greatest(2, length(rank::VARCHAR))::INTEGER, '0') || '.mp4 --primary-speed 1.25' AS render,
 'python3 render_qa.py output/short_' || lpad(rank::VARCHAR, greatest(2, length(rank::VARCHAR))::INTEGER, '0') || '.mp4 --platform douyin --json verify/short_' || lpad(rank::VARCHAR, greatest(2, length(rank::VARCHAR))::INTEGER, '0') || '_qa.json' AS "check" FROM r""")
def short_jobs(spark, sf_dir):
    from pyspark.sql import Window

    at = F.col("start") % 10_000_000
    u = units(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("start", "id")))
    rows = u.select("source", "rank", at.alias("start"), (at + F.col("end") - F.col("start")).alias("end"), (F.col("id") % 100).alias("score"))
    return publishing.short_jobs(rows, ["source"], "short", "douyin", 1.25, F.col("source") % 5 > 0)


@query("publish_checklists", """WITH p AS (SELECT p_partkey, list_concat(CASE WHEN p_size % 2 = 0 THEN ['video'] ELSE [] END, CASE WHEN p_size % 3 = 0 THEN ['cover', 'caption'] ELSE [] END) AS have FROM part), r AS (SELECT p_partkey, have, 'xhs' AS platform, ['video', 'cover', 'caption'] AS need FROM p UNION ALL SELECT p_partkey, have, 'douyin', ['video', 'caption'] FROM p)
SELECT p_partkey, platform, array_to_string(list_filter(need, lambda x: NOT list_contains(have, x)), ',') AS missing, CASE WHEN len(list_filter(need, lambda x: NOT list_contains(have, x))) > 0 THEN 'blocked' ELSE 'ready' END AS status FROM r""")
def publish_checklists(spark, sf_dir):
    size, none = F.col("p_size"), F.array().cast("array<string>")
    have = F.concat(F.when(size % 2 == 0, F.array(F.lit("video"))).otherwise(none), F.when(size % 3 == 0, F.array(F.lit("cover"), F.lit("caption"))).otherwise(none))
    rows = publishing.checklist(table(spark, sf_dir, "part").select("p_partkey", have.alias("have")), ["p_partkey"], {"xhs": ["video", "cover", "caption"], "douyin": ["video", "caption"]})
    return rows.withColumn("missing", F.array_join("missing", ","))


@query("cover_variants", """WITH s AS (SELECT unnest([1, 2, 3]) AS number, unnest(['bold', 'plain', 'split']) AS style), v AS (SELECT p_partkey, number, style, trim(CASE number WHEN 2 THEN CASE WHEN p_size % 4 = 0 THEN ' ' ELSE p_type END ELSE p_name END) AS text FROM part, s)
SELECT p_partkey, CAST(number AS INTEGER) AS number, style, text, CASE WHEN text = '' THEN 'no_text' WHEN length(text) < 2 THEN 'too_short' WHEN length(text) > 12 THEN 'too_long' END AS problem FROM v""")
def cover_variants(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("sub", F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_type")))
    return publishing.cover_variants(p, ["p_partkey"], ["bold", "plain", "split"], "p_name", "sub", 12)
