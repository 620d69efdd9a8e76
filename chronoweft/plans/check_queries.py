"""Queries over rules on single records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweft.operators import checks
from chronoweft.plans.cue_queries import _WORDS, _with_words
from chronoweft.plans.registry import query
from chronoweft.plans.views import SEGMENTS, UNITS, segments, table, units

_LABELS = " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{label}'" for label, p in checks.INTERNAL_TEXT.items())


@query("internal_text", f"SELECT doc_id, CASE {_LABELS} END AS leak FROM documents")
def internal_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", checks.internal_text(F.col("text")).alias("leak"))


@query("label_allowed", "SELECT p_partkey, lower(p_brand) IN ('brand#1', 'brand#11', 'brand#12', 'brand#21') AND lower(p_brand) NOT IN ('brand#12') AS allowed FROM part")
def label_allowed(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", checks.label_allowed(F.col("p_brand"), ["Brand#1", "BRAND#11", "Brand#12", "Brand#21"], ["brand#12"]).alias("allowed"))


@query("punchlines", "WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn, coalesce(before <> '' AND length(text) < length(before) * 0.4, FALSE) OR regexp_matches(text, '[！!？?]') OR regexp_matches(text, '哈哈|笑|对吧|就这|完了|没了|真的|太|绝了|离谱|卧槽|我去|可以|牛') AS punchline FROM p")
def punchlines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", checks.punchline(F.col("text"), F.col("before")).alias("punchline"))


@query("support_issues", """WITH r AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'image' ELSE 'voice' END AS mode, CASE p_size % 2 WHEN 0 THEN '9:16' ELSE '4:3' END AS aspect, p_size::DOUBLE AS seconds, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '720p' ELSE '4k' END AS resolution, p_size % 6 AS images FROM part)
SELECT p_partkey, concat_ws(';', CASE WHEN mode NOT IN ('text', 'image') THEN 'unsupported_mode:' || mode END, CASE WHEN aspect NOT IN ('16:9', '9:16') THEN 'unsupported_aspect:' || aspect END, CASE WHEN seconds < 5 OR seconds > 20 THEN 'unsupported_duration:' || CAST(seconds AS INTEGER) END,
 CASE WHEN resolution = '' THEN 'resolution_not_selected' WHEN resolution <> '720p' THEN 'unsupported_resolution:' || resolution END, CASE WHEN images > 3 THEN 'image_reference_limit_exceeded:' || images || '>3' END) AS issues,
 CASE WHEN seconds IN (5, 10) THEN '' ELSE 'unsupported_duration:' || CAST(seconds AS INTEGER) END AS fixed FROM r""")
def support_issues(spark, sf_dir):
    size = F.col("p_size")
    mode = F.when(size % 3 == 0, "text").when(size % 3 == 1, "image").otherwise("voice")
    aspect, resolution = F.when(size % 2 == 0, "9:16").otherwise("4:3"), F.when(size % 4 == 0, "").when(size % 4 == 1, "720p").otherwise("4k")
    ranged = checks.Capabilities(["text", "image"], ["16:9", "9:16"], ["720p"], 5, 20, most_images=3)
    fixed = checks.Capabilities(["text", "image", "voice"], ["*"], ["*"], fixed_seconds=(5, 10))
    issues = checks.support_issues(ranged, mode, aspect, size.cast("double"), resolution, size % 6)
    only = checks.support_issues(fixed, mode, aspect, size.cast("double"), F.lit("any"), size % 6)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(issues, ";").alias("issues"), F.array_join(only, ";").alias("fixed"))


@query("timeline_bounds", f"""WITH {SEGMENTS} SELECT source, id, CASE WHEN start > 30250 THEN 'cue_after_timeline' WHEN "end" > 30250 THEN 'cue_extends_past_timeline' END AS problem FROM s""")
def timeline_bounds(spark, sf_dir):
    return segments(spark, sf_dir).select("source", "id", checks.timeline_bound(F.col("start"), F.col("end"), F.lit(30_000)).alias("problem"))


@query("draft_problems", """WITH d AS (SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_name END AS hook, CASE WHEN p_size % 7 <> 0 THEN 'p' END AS pain, CASE WHEN p_size % 3 <> 0 THEN range(p_size % 8) END AS value, p_size AS seconds FROM part)
SELECT p_partkey, concat_ws('; ', CASE WHEN hook IS NULL THEN 'missing required field: hook' END, CASE WHEN pain IS NULL THEN 'missing required field: pain' END, 'missing required field: turn', CASE WHEN value IS NULL THEN 'missing required field: value' END,
 CASE WHEN length(hook) > 18 THEN 'hook too long (' || length(hook) || ' > 18 chars)' END, CASE WHEN len(value) NOT BETWEEN 1 AND 5 THEN 'value should have 1-5 bullets, got ' || len(value) END, CASE WHEN seconds > 30 THEN 'estimated_speech_seconds ' || seconds || ' exceeds max_duration 30' END) AS problems FROM d""")
def draft_problems(spark, sf_dir):
    size = F.col("p_size")
    points = F.when(size % 3 != 0, F.when(size % 8 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), (size % 8).cast("int"))))
    others = {"pain": F.when(size % 7 != 0, "p"), "turn": F.lit(None).cast("string"), "cta": F.lit("c")}
    problems = checks.draft_problems(F.when(size % 5 != 0, F.col("p_name")), others, points, size, 30)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(problems, "; ").alias("problems"))


@query("safe_zones", """WITH m AS (SELECT p_partkey, 1080.0::DOUBLE AS w, 1920.0::DOUBLE AS h, CASE WHEN p_size % 4 = 0 THEN p_size * 15.0::DOUBLE ELSE 60 / 1080::DOUBLE * 1080 END AS l, 210 / 1920::DOUBLE * 1920 AS t, CASE WHEN p_size % 4 = 0 THEN p_size * 15.0::DOUBLE ELSE 120 / 1080::DOUBLE * 1080 END AS r, 440 / 1920::DOUBLE * 1920 AS b FROM part)
SELECT p_partkey, CASE WHEN l + r < w AND t + b < h THEN round(l, 3) END AS "left", CASE WHEN l + r < w THEN round(w - r, 3) END AS "right", CASE WHEN l + r < w THEN round(w - l - r, 3) END AS width, CASE WHEN l + r < w THEN round(h - t - b, 3) END AS height FROM m""")
def safe_zones(spark, sf_dir):
    pixels = F.when(F.col("p_size") % 4 == 0, F.col("p_size") * 15.0)
    zone = checks.safe_zone(F.lit(1080.0), F.lit(1920.0), F.lit(60 / 1080), F.lit(210 / 1920), F.lit(120 / 1080), F.lit(440 / 1920), {"left": pixels, "right": pixels})
    return table(spark, sf_dir, "part").select("p_partkey", zone.alias("z")).select("p_partkey", "z.left", "z.right", "z.width", "z.height")


@query("shared_coverage", f"""WITH {UNITS}, c AS (SELECT id, 600.0::DOUBLE AS ref, ("end" - start) / 1000.0::DOUBLE AS src, (id % 900) - 200.0::DOUBLE AS o FROM u), e AS (SELECT *, greatest(0.0, o) AS a, least(ref, o + src) AS b FROM c)
SELECT id, CASE WHEN b > a THEN round(a, 4) END AS ref_start, CASE WHEN b > a THEN round(b, 4) END AS ref_end, CASE WHEN b > a THEN round(a - o, 4) END AS src_start, CASE WHEN b > a THEN round(b - o, 4) END AS src_end FROM e""")
def shared_coverage(spark, sf_dir):
    u = units(spark, sf_dir)
    c = checks.shared_coverage(F.lit(600.0), (F.col("end") - F.col("start")) / 1000, F.col("id") % 900 - F.lit(200.0))
    return u.select("id", c.alias("c")).select("id", "c.ref_start", "c.ref_end", "c.src_start", "c.src_end")


@query("sample_points", f"""WITH {UNITS}, p AS (SELECT id, start / 1000.0::DOUBLE AS a, "end" / 1000.0::DOUBLE AS b, unnest([0.1, 0.5, 0.9])::DOUBLE AS fraction FROM u) SELECT id, fraction, round(a + (b - a) * fraction, 6) AS time FROM p""")
def sample_points(spark, sf_dir):
    return units(spark, sf_dir).select("id", F.inline(checks.sample_points(F.col("start") / 1000, F.col("end") / 1000)))


@query("preview_times", f"""WITH {UNITS}, d AS (SELECT id, ("end" - start) / 999983.0::DOUBLE AS n FROM u), t AS (SELECT id, n, [round(least(n * x, greatest(0.0, n - least(0.04, n / 2))), 3) FOR x IN [0.15::DOUBLE, 0.5::DOUBLE, 0.85::DOUBLE]] AS ts FROM d)
SELECT id, CASE WHEN n > 0 AND len(list_distinct(ts)) = 3 THEN ts[1] END AS first, CASE WHEN n > 0 AND len(list_distinct(ts)) = 3 THEN ts[3] END AS last FROM t""")
def preview_times(spark, sf_dir):
    times = checks.preview_times((F.col("end") - F.col("start")) / 999_983)
    return units(spark, sf_dir).select("id", times.alias("t")).select("id", F.col("t")[0].alias("first"), F.col("t")[2].alias("last"))


@query("candidate_ids", f"""WITH {UNITS} SELECT id, 't' || source || ':' || trim(regexp_replace(lower('Take ' || speaker || '.MP4'), '[^a-z0-9]+', '-', 'g'), '-') || '-' || substr(sha1('Take ' || speaker || '.MP4'), 1, 6) || ':' || start || '-' || "end" AS candidate FROM u""")
def candidate_ids(spark, sf_dir):
    take = F.concat(F.lit("Take "), "speaker", F.lit(".MP4"))
    return units(spark, sf_dir).select("id", checks.candidate_id(F.concat(F.lit("t"), F.col("source").cast("string")), take, F.col("start"), F.col("end")).alias("candidate"))


@query("proposal_ids", """SELECT p_partkey, 'patch-' || substr(sha256('{"category":"' || p_brand || '","replacement":' || CASE WHEN p_size % 2 = 0 THEN 'null' ELSE '"' || p_type || '"' END || ',"segment_id":' || p_partkey || ',"source":"' || p_name || '","span_end":' || p_size || ',"span_start":0}'), 1, 12) AS proposal FROM part""")
def proposal_ids(spark, sf_dir):
    changed = F.when(F.col("p_size") % 2 == 1, F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", checks.proposal_id(F.col("p_brand"), changed, F.col("p_partkey"), F.col("p_name"), F.col("p_size"), F.lit(0)).alias("proposal"))


@query("credit_lines", """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_name ELSE concat_ws(' ', CASE WHEN p_size % 2 = 0 THEN 'Asset by ' || p_brand ELSE 'Asset' END, CASE WHEN p_size % 3 = 0 THEN 'on Free Stock' END, CASE WHEN p_size % 7 <> 0 THEN 'http://x/' || p_partkey END, CASE WHEN p_size % 4 = 1 THEN '(CC0)' END) END AS credit FROM part""")
def credit_lines(spark, sf_dir):
    size = F.col("p_size")
    url = F.when(size % 7 != 0, F.concat(F.lit("http://x/"), F.col("p_partkey").cast("string"))).otherwise("")
    line = checks.credit_line(F.when(size % 3 == 0, "free_stock").otherwise(""), F.when(size % 2 == 0, F.col("p_brand")), url, F.when(size % 4 == 1, "CC0"), F.when(size % 5 == 0, F.col("p_name")).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("credit"))


@query("speech_speed", r"""SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' OR turn % 5 = 0 THEN 0.0 WHEN turn % 2 = 1 OR regexp_matches(text, '[\x{4e00}-\x{9fff}]') THEN length(replace(text, chr(10), '')) / 7.5::DOUBLE / 5.2::DOUBLE ELSE len(regexp_extract_all(text, '\S+')) / 7.5::DOUBLE / 2.7::DOUBLE END::DOUBLE AS speed FROM conversations""")
def speech_speed(spark, sf_dir):
    speed = checks.speech_speed(F.col("text"), F.when(F.col("turn") % 5 == 0, 0.0).otherwise(7.5), F.when(F.col("turn") % 2 == 1, "zh").otherwise("en"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", speed.alias("speed"))


@query("segment_budget", f"""WITH {UNITS} SELECT source, CAST(sum("end" - start) AS BIGINT) AS total, CASE WHEN sum("end" - start) > 150000000 THEN 'fail' ELSE 'warn' END AS status FROM u GROUP BY source""")
def segment_budget(spark, sf_dir):
    return checks.segment_budget(units(spark, sf_dir), ["source"], 150_000_000)


@query("sampled_parts", f"""WITH {UNITS}, k AS (SELECT source, id, speaker, row_number() OVER (PARTITION BY source ORDER BY start, id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source, speaker ORDER BY start, id) AS first FROM u)
SELECT source, id FROM k WHERE n <= 12 OR first = 1 OR list_contains([CAST(round_even(p * (n - 1) / 11.0::DOUBLE, 0) AS BIGINT) FOR p IN range(0, 12)], k)""")
def sampled_parts(spark, sf_dir):
    return checks.sampled_parts(units(spark, sf_dir), ["source"], ["start", "id"], 12, "speaker").select("source", "id")


@query("retry_choices", """WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations) SELECT conv_id, turn, CASE WHEN length(after) >= greatest(1, floor(length(text) * 1.15::DOUBLE)) THEN 'repeated_before_retry' ELSE 'repeated_duplicate' END AS choice FROM p WHERE after IS NOT NULL""")
def retry_choices(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("after", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("after IS NOT NULL")
    return c.select("conv_id", "turn", checks.retry_choice(F.col("text"), F.col("after")).alias("choice"))


_MISSING = " ".join(f"WHEN list_contains(missing, '{k}') THEN '{v}'" for k, v in checks.NEEDS_BY_MISSING.items())
_BLOCKED = " ".join(f"WHEN list_contains(blocked, '{k}') THEN '{v}'" for k, v in checks.NEEDS_BY_BLOCKED.items())


@query("phases", f"""WITH n AS (SELECT {list(checks.NEEDS_BY_MISSING)} AS m, {[*checks.NEEDS_BY_BLOCKED, "zz_other"]} AS b), p AS (SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN 'ready' WHEN 1 THEN 'warn' ELSE 'open' END AS status, CASE p_size % 2 WHEN 0 THEN 'publish' ELSE '' END AS stage,
 CASE WHEN p_size % 3 = 0 THEN [m[(p_partkey % 8) + 1], m[(p_size % 8) + 1]] ELSE []::VARCHAR[] END AS missing, CASE WHEN p_size % 4 = 0 THEN [b[(p_partkey % 7) + 1]] ELSE []::VARCHAR[] END AS blocked FROM part, n)
SELECT p_partkey, CASE WHEN status = 'ready' THEN CASE WHEN stage <> '' THEN stage || '_ready' ELSE 'ready' END {_MISSING} {_BLOCKED} WHEN len(blocked) > 0 THEN 'blocked_by_' || list_min(blocked) WHEN status = 'warn' THEN 'needs_warning_review' ELSE 'in_progress' END AS phase FROM p""")
def phases(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    m, b = F.array(*map(F.lit, checks.NEEDS_BY_MISSING)), F.array(*map(F.lit, [*checks.NEEDS_BY_BLOCKED, "zz_other"]))
    at = lambda names, k: F.element_at(names, (k + 1).cast("int"))
    none = F.array().cast("array<string>")
    missing = F.when(size % 3 == 0, F.array(at(m, key % 8), at(m, size % 8))).otherwise(none)
    blocked = F.when(size % 4 == 0, F.array(at(b, key % 7))).otherwise(none)
    status = F.when(size % 9 == 0, "ready").when(size % 9 == 1, "warn").otherwise("open")
    return table(spark, sf_dir, "part").select("p_partkey", checks.phase(status, F.when(size % 2 == 0, "publish").otherwise(""), missing, blocked).alias("phase"))


@query("music_moods", """WITH h AS (SELECT doc_id, contains(lower(text), 'award')::INT + contains(lower(text), 'the')::INT + contains(lower(text), 'und')::INT AS calm, contains(lower(text), 'der')::INT + contains(lower(text), 'que')::INT AS bold FROM documents)
SELECT doc_id, CASE WHEN greatest(calm, bold) = 0 OR calm IS NULL THEN 'plain' WHEN bold >= calm THEN 'bold' ELSE 'calm' END AS mood FROM h""")
def music_moods(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", checks.best_named(F.col("text"), {"calm": ["award", "the", "und"], "bold": ["der", "que"]}, "plain").alias("mood"))


@query("best_audio", """WITH a AS (SELECT p_brand, p_name AS path, CASE p_size % 3 WHEN 0 THEN 'music' WHEN 1 THEN 'audio' ELSE 'sfx' END AS kind, list_append(string_split(lower(p_type), ' '), CASE WHEN p_size % 5 = 0 THEN 'bgm' ELSE 'x' END) AS t FROM part),
s AS (SELECT p_brand, path, CASE kind WHEN 'music' THEN 6 WHEN 'audio' THEN 1 ELSE 0 END + 4 * len(list_intersect(t, ['brass', 'small', 'steel'])) + CASE WHEN list_has_any(t, ['bgm', 'music', 'bed']) THEN 2 ELSE 0 END AS score FROM a)
SELECT p_brand, path, CAST(score AS INTEGER) AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, path) = 1""")
def best_audio(spark, sf_dir):
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "music").when(size % 3 == 1, "audio").otherwise("sfx")
    tokens = F.array_append(F.split(F.lower("p_type"), " "), F.when(size % 5 == 0, "bgm").otherwise("x"))
    return checks.best_audio(table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("path"), kind.alias("kind"), tokens.alias("tokens")), ["p_brand"], "music", ["Brass", "small", "steel"])


@query("story_sections", """WITH i AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(text, 'que') THEN 'cta' WHEN k = 0 THEN 'hook' WHEN k = n - 1 THEN 'cta' WHEN k / greatest(1, n - 1)::DOUBLE <= 0.25 THEN 'pain' WHEN k / greatest(1, n - 1)::DOUBLE <= 0.45 OR contains(lower(text), 'but') OR contains(lower(text), 'however') THEN 'turn' ELSE 'value' END AS section FROM i""")
def story_sections(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    k, n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1, F.count("*").over(Window.partitionBy("conv_id"))
    return c.withColumn("k", k).withColumn("n", n).select("conv_id", "turn", checks.story_section(F.col("k"), F.col("n"), F.col("text"), ["que"]).alias("section"))


@query("anchors", f"""WITH {_WORDS}, n AS (SELECT *, lower(CASE id % 3 WHEN 0 THEN 'the' WHEN 1 THEN substr(text, 4, 9) ELSE 'nowhere at all' END) AS raw FROM w), m AS (SELECT *, trim(raw) AS needle FROM n)
SELECT source, id, CASE WHEN needle = '' THEN NULL ELSE coalesce(list_filter(ws, lambda x: contains(lower(x.text), needle) OR contains(needle, lower(x.text)))[1].start::DOUBLE, CASE WHEN strpos(lower(text), needle) > 0 THEN start + ("end" - start) * ((strpos(lower(text), needle) - 1) / greatest(length(text), 1)::DOUBLE) END) END AS "at" FROM m""")
def anchors(spark, sf_dir):
    s = _with_words(spark, sf_dir)
    needle = F.when(F.col("id") % 3 == 0, "the").when(F.col("id") % 3 == 1, F.substring("text", 4, 9)).otherwise("nowhere at all")
    return s.select("source", "id", checks.anchor(F.col("words"), needle, F.col("text"), F.col("start"), F.col("end")).alias("at"))
