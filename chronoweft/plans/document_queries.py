"""Queries over nested documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweft.operators import documents
from chronoweft.plans.registry import query
from chronoweft.plans.views import UNITS, table, units

_JSON = """j AS (SELECT p_partkey, '{"name":"' || p_name || '","size":' || p_size || ',"clips":[{"path":"a' || p_size % 5 || '.mp4","cover":{"path":"' || p_brand || '.PNG"}},{"path":"a' || p_size % 3 || '.mp4","tags":["x",' || p_size || ',null,true]}],"none":null,"task_id":"' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE ' ' END || '","result":{"id":"r' || p_partkey || '"}}' AS json FROM part),
t AS (SELECT p_partkey, fullkey, key, atom, type FROM j, json_tree(json) WHERE type NOT IN ('OBJECT', 'ARRAY', 'NULL')),
v AS (SELECT p_partkey, replace(fullkey, '"', '') AS location, CASE WHEN type = 'VARCHAR' THEN atom->>'$' WHEN type = 'BOOLEAN' THEN 'true' ELSE CAST(atom AS VARCHAR) END AS value, CASE WHEN key LIKE '%[%' OR regexp_matches(fullkey, '\\]$') THEN 'tags' ELSE key END AS key FROM t)"""


def _values(spark, sf_dir):
    c, size = F.col, F.col("p_size").cast("string")
    mod = lambda k: (F.col("p_size") % k).cast("string")
    json = F.concat(
        F.lit('{"name":"'), c("p_name"), F.lit('","size":'), size, F.lit(',"clips":[{"path":"a'), mod(5), F.lit('.mp4","cover":{"path":"'), c("p_brand"), F.lit('.PNG"}},{"path":"a'), mod(3), F.lit('.mp4","tags":["x",'), size,
        F.lit(',null,true]}],"none":null,"task_id":"'), F.when(c("p_size") % 2 == 0, c("p_type")).otherwise(" "), F.lit('","result":{"id":"r'), c("p_partkey").cast("string"), F.lit('"}}'),
    )
    return documents.walked(table(spark, sf_dir, "part").select("p_partkey", json.alias("json")), ["p_partkey"])


@query("document_values", f"WITH {_JSON} SELECT p_partkey, location, value FROM v")
def document_values(spark, sf_dir):
    return _values(spark, sf_dir).select("p_partkey", "location", "value")


@query("found_values", f"WITH {_JSON} SELECT p_partkey, first(value ORDER BY CASE key WHEN 'task_id' THEN 1 ELSE 2 END, length(location), location) AS value FROM v WHERE key IN ('task_id', 'id') AND trim(value) <> '' GROUP BY p_partkey")
def found_values(spark, sf_dir):
    return documents.found_values(_values(spark, sf_dir), ["p_partkey"], ["task_id", "id"])


@query("document_paths", f"WITH {_JSON} SELECT p_partkey, value AS path, count(*) AS uses FROM v WHERE regexp_matches(lower(value), '\\.(mp4|mov|wav|mp3|png|jpg)$') GROUP BY ALL")
def document_paths(spark, sf_dir):
    return documents.media_paths(_values(spark, sf_dir), ["p_partkey"])


@query("document_slots", f"""WITH {_JSON}, p AS (SELECT p_partkey, location, value AS path, min(location) OVER (PARTITION BY p_partkey, value) AS first FROM v WHERE regexp_matches(lower(value), '\\.(mp4|mov|wav|mp3|png|jpg)$')) SELECT p_partkey, location, path, 'slot_' || dense_rank() OVER (PARTITION BY p_partkey ORDER BY first) AS slot FROM p""")
def document_slots(spark, sf_dir):
    return documents.slots(_values(spark, sf_dir), ["p_partkey"])


@query("document_text", f"WITH {_JSON} SELECT p_partkey, lower(string_agg(value, ' ' ORDER BY location, value)) AS text FROM v GROUP BY p_partkey")
def document_text(spark, sf_dir):
    return documents.flat_text(_values(spark, sf_dir), ["p_partkey"])


@query("profiled", """WITH c AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE ' ' END AS font, CASE WHEN p_size % 3 = 0 THEN p_brand END AS color FROM part)
SELECT p_partkey, CASE WHEN trim(font) = '' THEN 'Sans' ELSE font END AS font, coalesce(color, 'white') AS color, concat_ws(',', CASE WHEN trim(font) = '' THEN 'font' END, CASE WHEN color IS NULL THEN 'color' END) AS applied, concat_ws(',', CASE WHEN trim(font) <> '' THEN 'font' END, CASE WHEN color IS NOT NULL THEN 'color' END) AS kept FROM c""")
def profiled(spark, sf_dir):
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(size % 2 == 0, F.col("p_name")).otherwise(" ").alias("font"), F.when(size % 3 == 0, F.col("p_brand")).alias("color"))
    return documents.with_profile(rows, {"font": F.lit("Sans"), "color": F.lit("white")})


@query("corrections", r"""WITH l AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '# ' || p_name || ' => x' WHEN 1 THEN '  ' || p_name || ' => ' || p_brand || ' ' WHEN 2 THEN p_name || '->' || p_brand WHEN 3 THEN p_name || '=' ELSE p_name END AS line FROM part)
SELECT p_partkey, regexp_extract(line, '^\s*([^#\s].*?)\s*(?:=>|->|=)\s*(.*?)\s*$', 1) AS wrong, regexp_extract(line, '^\s*([^#\s].*?)\s*(?:=>|->|=)\s*(.*?)\s*$', 2) AS right FROM l WHERE regexp_extract(line, '^\s*([^#\s].*?)\s*(?:=>|->|=)\s*(.*?)\s*$', 1) <> ''""")
def corrections(spark, sf_dir):
    kind = F.col("p_size") % 5
    line = F.when(kind == 0, F.concat(F.lit("# "), "p_name", F.lit(" => x"))).when(kind == 1, F.concat(F.lit("  "), "p_name", F.lit(" => "), "p_brand", F.lit(" "))).when(kind == 2, F.concat("p_name", F.lit("->"), "p_brand")).when(kind == 3, F.concat("p_name", F.lit("="))).otherwise(F.col("p_name"))
    return documents.corrections(table(spark, sf_dir, "part").select("p_partkey", line.alias("line")), ["p_partkey"])


@query("nested_detections", """WITH d AS (SELECT label AS source, vec_id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, abs(embedding[3]::DOUBLE) AS c FROM embeddings), f AS (SELECT source, CASE WHEN vec_id % 3 = 0 THEN 'own' || vec_id ELSE 'f' || source END AS frame_id, CASE WHEN vec_id % 4 = 0 THEN vec_id::DOUBLE ELSE 7.5::DOUBLE END AS time,
 CASE WHEN vec_id % 5 = 0 THEN 'object' ELSE 'cat' || vec_id % 2 END AS label, least(1.0::DOUBLE, CASE WHEN vec_id % 7 = 0 THEN 1.0::DOUBLE ELSE c END) AS confidence, x AS x1, y AS y1, CASE WHEN vec_id % 2 = 0 THEN x + 10 ELSE x + 20 END AS x2, CASE WHEN vec_id % 11 = 0 THEN y - 1 ELSE y + 10 END AS y2 FROM d)
SELECT * FROM f WHERE confidence >= 0.05 AND x2 > x1 AND y2 > y1""")
def nested_detections(spark, sf_dir):
    i, v = F.col("vec_id"), lambda k: F.col("embedding")[k].cast("double")
    x, y = v(0) * 100, v(1) * 100
    box = F.struct(
        F.when(i % 3 == 0, F.concat(F.lit("own"), i.cast("string"))).otherwise("").alias("frame_id"), F.when(i % 4 == 0, i.cast("double")).alias("time"), F.when(i % 5 == 0, " ").otherwise(F.concat(F.lit("CAT"), (i % 2).cast("string"))).alias("label"), F.when(i % 7 > 0, F.abs(v(2))).alias("confidence"),
        x.alias("x1"), y.alias("y1"), F.when(i % 2 == 0, x + 10).alias("x2"), F.when(i % 11 == 0, y - 1).otherwise(y + 10).alias("y2"), F.lit(20.0).alias("w"), F.lit(1.0).alias("h"),
    )
    frames = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("source")).agg(F.collect_list(box).alias("detections")).withColumn("frame_id", F.concat(F.lit("f"), F.col("source").cast("string"))).withColumn("time", F.lit(7.5))
    return documents.detections(frames, ["source"])


_HAS = documents.POLICIES
_POLICY = ", ".join(f"('{n}', '{p['license']}', {str(p['attribution_required']).upper()}, {str(p['credit_recommended']).upper()})" for n, p in _HAS.items())
_PROVIDERS = ["pexels", "owned", "youtube", "giphy", "studio", "dreamina", "web"]
_LICENCES = ["", "CC BY 4.0", "cc0", "Editorial only", "All Rights Reserved", "cc-by from pexels"]


@query("asset_status", rf"""WITH pol(provider, plicense, required, recommended) AS (VALUES {_POLICY}),
a AS (SELECT p_partkey, {_PROVIDERS}[p_size % 7 + 1] AS provider, {_LICENCES}[p_partkey % 6 + 1] AS licence, CASE WHEN p_size % 3 = 0 THEN 'https://x.example/' || p_partkey ELSE '' END AS url, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS creator,
 CASE WHEN p_size % 5 = 0 THEN 'by me' ELSE ' ' END AS credit, CASE p_partkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS must_, p_size % 2 = 0 AS cleared, CASE WHEN p_partkey % 11 = 0 THEN 'HTTPS://cdn/' || p_partkey ELSE 'media/' || p_partkey END AS path, p_size % 13 > 0 AS there FROM part),
b AS (SELECT a.*, CASE WHEN licence <> '' THEN licence ELSE coalesce(plicense, '') END AS l, coalesce(recommended, FALSE) AS rec, required FROM a LEFT JOIN pol USING (provider)),
c AS (SELECT *, regexp_matches(path, '^https?://', 'i') AS remote, coalesce(required, must_, regexp_matches(l, '{documents.ATTRIBUTION_LICENSE}') AND NOT regexp_matches(l, '{documents.NO_ATTRIBUTION_LICENSE}')) AND trim(credit) = '' AND NOT (coalesce(creator, '') <> '' AND url <> '') AS incomplete FROM b),
d AS (SELECT *, concat_ws(',', CASE WHEN NOT there AND NOT remote THEN 'file_missing' END, CASE WHEN regexp_matches(l, '{documents.BLOCKED_LICENSE}') THEN 'license_not_publish_safe' END,
  CASE WHEN provider IN ('youtube', 'giphy', 'web') AND l = '' AND NOT cleared THEN 'external_asset_needs_usage_clearance' END, CASE WHEN incomplete THEN 'attribution_required_but_incomplete' END) AS issues,
 concat_ws(',', CASE WHEN remote THEN 'remote_asset_url_not_local_file' END, CASE WHEN l = '' THEN 'license_missing' END, CASE WHEN provider IN ('pexels', 'giphy', 'youtube', 'web') AND url = '' THEN 'source_url_missing' END,
  CASE WHEN NOT incomplete AND rec AND trim(credit) = '' AND coalesce(creator, '') = '' AND url = '' THEN 'credit_metadata_missing' END) AS warnings FROM c)
SELECT p_partkey, CASE WHEN issues <> '' THEN 'blocked' WHEN warnings <> '' THEN 'warn' ELSE 'ready' END AS status, issues, warnings FROM d""")
def asset_status(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    of = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    told = documents.asset_status(
        of(_PROVIDERS, size % 7), of(_LICENCES, key % 6), F.when(size % 3 == 0, F.concat(F.lit("https://x.example/"), key.cast("string"))).otherwise(""), F.when(key % 4 == 0, F.col("p_brand")), F.when(size % 5 == 0, "by me").otherwise(" "),
        F.when(key % 5 == 0, True).when(key % 5 == 1, False), size % 2 == 0, F.concat(F.when(key % 11 == 0, "HTTPS://cdn/").otherwise("media/"), key.cast("string")), size % 13 > 0,
    )
    return table(spark, sf_dir, "part").select("p_partkey", told.alias("s")).select("p_partkey", "s.*")


# Weights of the dimensions of an option.
_WEIGHTS = {"task_fit": 0.30, "output_quality": 0.20, "control": 0.15, "reliability": 0.15, "cost_efficiency": 0.10, "latency": 0.05, "continuity": 0.05}
_CLAMP = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {0}))"


@query("option_scores", f"""WITH d AS (SELECT vec_id, {", ".join(f"abs(embedding[{k}]::DOUBLE) * 3 AS d{k}" for k in range(1, 8))}, vec_id % 3 = 0 AS pri, vec_id % 5 = 0 AS fall, vec_id % 4 = 0 AS cand, vec_id % 7 = 0 AS lacks FROM embeddings),
e AS (SELECT vec_id, lacks, CASE WHEN pri THEN {_CLAMP.format("d1 + 0.08::DOUBLE")} WHEN fall THEN d1 ELSE {_CLAMP.format("d1 - 0.05::DOUBLE")} END AS d1, d2, d3, CASE WHEN cand THEN {_CLAMP.format("d4 + 0.08::DOUBLE")} ELSE d4 END AS d4, d5,
 CASE WHEN cand THEN {_CLAMP.format("d6 + 0.06::DOUBLE")} ELSE d6 END AS d6, CASE WHEN NOT pri AND fall THEN {_CLAMP.format("d7 + 0.08::DOUBLE")} ELSE d7 END AS d7 FROM d),
f AS (SELECT vec_id, d1, d2, d3, CASE WHEN lacks THEN {_CLAMP.format("d4 - 0.45::DOUBLE")} ELSE d4 END AS d4, d5, CASE WHEN lacks THEN {_CLAMP.format("d6 - 0.15::DOUBLE")} ELSE d6 END AS d6, d7 FROM e)
SELECT vec_id, round({" + ".join(f"d{k} * {w}::DOUBLE" for k, w in enumerate(_WEIGHTS.values(), 1))}, 4) AS score FROM f""")
def option_scores(spark, sf_dir):
    i = F.col("vec_id")
    dimensions = {n: F.abs(F.col("embedding")[k].cast("double")) * 3 for k, n in enumerate(_WEIGHTS)}
    return table(spark, sf_dir, "embeddings").select("vec_id", documents.option_score(dimensions, _WEIGHTS, i % 3 == 0, i % 5 == 0, i % 4 == 0, i % 7 == 0).alias("score"))


@query("review_segments", f"""WITH {UNITS}, f AS (SELECT source, ['black_frames', 'frozen_video', 'silence', 'loudness'][id % 4 + 1] AS "check", CASE id % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS severity, start, "end", max("end") OVER (PARTITION BY source) AS length FROM u),
g AS (SELECT source, "check", severity, greatest(0, start - 500) AS start, least(greatest(greatest(0, start - 500), "end" + 500), length) AS "end" FROM f WHERE "check" <> 'loudness')
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY CASE severity WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, start, "check", "end") AS INTEGER) AS nth, "check", severity, start, "end" FROM g QUALIFY nth <= 24""")
def review_segments(spark, sf_dir):
    i = F.col("id")
    check = F.get(F.array(*map(F.lit, ("black_frames", "frozen_video", "silence", "loudness"))), (i % 4).cast("int"))
    rows = units(spark, sf_dir).select("source", check.alias("check"), F.when(i % 3 == 0, "fail").when(i % 3 == 1, "warn").otherwise("pass").alias("severity"), "start", "end", F.max("end").over(Window.partitionBy("source")).alias("length"))
    return documents.review_segments(rows, ["source"], 500, 24, "length")


@query("loudest_streams", """WITH s AS (SELECT label, vec_id % 4 AS stream, CASE WHEN vec_id % 3 > 0 THEN round(embedding[1]::DOUBLE, 1) END AS level FROM embeddings) SELECT label, stream, level FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY level IS NULL, level DESC, stream) = 1""")
def loudest_streams(spark, sf_dir):
    level = F.when(F.col("vec_id") % 3 > 0, F.round(F.col("embedding")[0].cast("double"), 1))
    return documents.loudest(table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 4).alias("stream"), level.alias("level")), ["label"])
