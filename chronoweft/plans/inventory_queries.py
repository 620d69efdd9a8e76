"""Queries over files, claims, cues and takes."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.operators import inventory
from chronoweft.plans.registry import query
from chronoweft.plans.views import SEGMENTS, UNITS, segments, table, units

_PATHS = """f AS (SELECT p_brand, replace(p_name, ' ', '/') || '/' || p_size || ['.mp4', '.wav', '.png', '.txt'][p_partkey % 4 + 1] AS path, p_size AS length, p_partkey AS modified FROM part)"""


def _files(spark, sf_dir):
    ending = F.element_at(F.array(*map(F.lit, (".mp4", ".wav", ".png", ".txt"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    path = F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/"), F.col("p_size").cast("string"), ending)
    return table(spark, sf_dir, "part").select("p_brand", path.alias("path"), F.col("p_size").alias("length"), F.col("p_partkey").alias("modified"))


@query("file_inventory", f"""WITH {_PATHS}, o AS (SELECT p_brand, path, max(length) AS length FROM f GROUP BY ALL), c AS (SELECT p_brand, length, CASE WHEN ends_with(path, 'mp4') THEN 'video' WHEN ends_with(path, 'wav') THEN 'audio' WHEN ends_with(path, 'png') THEN 'image' ELSE 'other' END AS kind,
 CASE WHEN list_has_any(regexp_split_to_array(lower(path), '[^a-z0-9]+'), ['small', 'cold']) THEN 'raw' WHEN list_has_any(regexp_split_to_array(lower(path), '[^a-z0-9]+'), ['widget', 'bolt']) THEN 'parts' ELSE 'other' END AS category FROM o)
SELECT p_brand, kind, category, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes FROM c GROUP BY ALL""")
def file_inventory(spark, sf_dir):
    return inventory.inventory(_files(spark, sf_dir), ["p_brand"], {"raw": ["small", "cold"], "parts": ["widget", "bolt"]})


@query("artifacts", f"""WITH {_PATHS}, k AS (SELECT * FROM f WHERE NOT list_has_any(string_split(path, '/'), ['small', 'tmp'])), m AS (SELECT p_brand, path, modified, 'video' AS category FROM k WHERE regexp_matches(path, '\\.mp4$') UNION ALL SELECT p_brand, path, modified, 'hot' FROM k WHERE regexp_matches(path, '^hot/') OR regexp_matches(path, 'bolt'))
SELECT p_brand, category, path, CAST(row_number() OVER (PARTITION BY p_brand, category ORDER BY modified DESC, path) AS INTEGER) AS nth FROM m""")
def artifacts(spark, sf_dir):
    return inventory.artifacts(_files(spark, sf_dir), ["p_brand"], {"video": [r"\.mp4$"], "hot": ["^hot/", "bolt"]}, ["small", "tmp"])


@query("claims", """WITH l AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '  ' ELSE p_name END || CASE WHEN p_size % 3 > 0 THEN ' | http://x/' || p_partkey ELSE '' END || CASE WHEN p_size % 3 = 2 THEN '| Primary | ' ELSE '' END AS line FROM part), s AS (SELECT p_partkey, string_split(line, '|') AS p FROM l)
SELECT p_partkey, nullif(trim(p[1]), '') AS claim, nullif(trim(p[2]), '') AS url, lower(nullif(trim(p[3]), '')) AS kind, nullif(trim(p[4]), '') AS screenshot FROM s WHERE trim(p[1]) <> ''""")
def claims(spark, sf_dir):
    size = F.col("p_size")
    line = F.concat(F.when(size % 7 == 0, "  ").otherwise(F.col("p_name")), F.when(size % 3 > 0, F.concat(F.lit(" | http://x/"), F.col("p_partkey").cast("string"))).otherwise(""), F.when(size % 3 == 2, "| Primary | ").otherwise(""))
    return inventory.claims(table(spark, sf_dir, "part").select("p_partkey", line.alias("line")), ["p_partkey"])


@query("whole_numbers", "SELECT p_partkey, array_to_string(list_filter([TRY_CAST(x AS INTEGER) FOR x IN regexp_split_to_array(p_size || ', x,' || p_partkey || ' 7b ' || p_name, '[,\\s]+')], lambda v: v IS NOT NULL), ',') AS numbers FROM part")
def whole_numbers(spark, sf_dir):
    text = F.concat(F.col("p_size").cast("string"), F.lit(", x,"), F.col("p_partkey").cast("string"), F.lit(" 7b "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(inventory.whole_numbers(text), ",").alias("numbers"))


@query("plan_cues", f"""WITH {UNITS}, k AS (SELECT source, CASE id % 3 WHEN 0 THEN 'sticker' WHEN 1 THEN 'broll' ELSE 'sound' END AS kind, start::DOUBLE AS start, CASE WHEN id % 2 = 0 THEN "end"::DOUBLE WHEN id % 5 = 0 THEN start + 7.0::DOUBLE ELSE start + 2.0::DOUBLE END AS "end", speaker AS label FROM u) SELECT * FROM k WHERE "end" > start""")
def plan_cues(spark, sf_dir):
    i = F.col("id")
    cue = F.struct(F.col("start").cast("double").alias("start"), F.when(i % 2 == 0, F.col("end")).cast("double").alias("end"), F.when(i % 5 == 0, 7.0).alias("duration"), F.col("speaker").alias("label"))
    u = units(spark, sf_dir)
    plans = u.groupBy("source").agg(*(F.collect_list(F.when(i % 3 == k, cue)).alias(c) for k, c in enumerate(("stickers", "broll", "sounds"))))
    return inventory.plan_cues(plans, ["source"], {"stickers": "sticker", "broll": "broll", "sounds": "sound"})


@query("shots_with_assets", """WITH a AS (SELECT o_custkey AS shot, min(o_orderpriority) AS path FROM orders WHERE o_orderkey % 11 = 0 AND o_orderpriority <> '' GROUP BY 1) SELECT c_custkey, path, CASE WHEN path IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM customer LEFT JOIN a ON c_custkey = shot""")
def shots_with_assets(spark, sf_dir):
    shots = table(spark, sf_dir, "customer").select(F.lit(1).alias("plan"), F.col("c_custkey").alias("shot_id"))
    assets = table(spark, sf_dir, "orders").filter("o_orderkey % 11 = 0").select(F.lit(1).alias("plan"), F.col("o_custkey").alias("shot_id"), F.col("o_orderpriority").alias("path"))
    return inventory.shots_with_assets(shots, assets, ["plan"]).select(F.col("shot_id").alias("c_custkey"), "path", "status")


@query("source_overrides", """WITH s AS (SELECT c_custkey AS label, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS media FROM customer), o AS (SELECT c_custkey * 3 AS label, 'other' || c_custkey AS media FROM customer)
SELECT coalesce(s.label, o.label) AS label, coalesce(o.media, s.media) AS media, CASE WHEN s.label IS NULL THEN 'orphan_override' WHEN coalesce(o.media, s.media) IS NULL THEN 'unset' END AS problem FROM s FULL JOIN o ON s.label = o.label""")
def source_overrides(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    sources = c.select(F.col("c_custkey").alias("label"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("media"))
    return inventory.with_overrides(sources, c.select((F.col("c_custkey") * 3).alias("label"), F.concat(F.lit("other"), F.col("c_custkey").cast("string")).alias("media")))


@query("takes", f"""WITH {SEGMENTS}, c AS (SELECT source, count(*) AS units, count(*) FILTER (id % 4 = 0) AS events, max("end") AS duration FROM s GROUP BY source), p AS (SELECT source, count(*) AS phrases FROM s WHERE source % 2 = 0 AND id % 2 = 0 GROUP BY source)
SELECT source, units, events, duration, coalesce(phrases, 0) AS phrases FROM c LEFT JOIN p USING (source)""")
def takes(spark, sf_dir):
    s = segments(spark, sf_dir)
    return inventory.takes(s.select("source", "end", F.when(F.col("id") % 4 == 0, "audio_event").otherwise("word").alias("kind")), s.filter("source % 2 = 0 AND id % 2 = 0"), ["source"])


@query("sync_features", """WITH h AS (SELECT user_id AS source, CAST(floor((epoch_us(ts) // 1000) / 21600000) AS BIGINT) AS frame, sum(CAST(floor(value * 100) AS BIGINT))::DOUBLE AS value FROM events GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY value) AS k, count(*) OVER (PARTITION BY source) AS n FROM h), e AS (SELECT source, min(value) FILTER (k - 1 = round_even((n - 1) * 0.2::DOUBLE, 0)) AS low, max(value) AS high FROM o GROUP BY source),
s AS (SELECT h.*, CASE WHEN high - low <= 1e-9 THEN 0.0::DOUBLE ELSE greatest(0.0, (value - low) / (high - low)) END AS e FROM h JOIN e USING (source)) SELECT source, frame, value, 0.8::DOUBLE * e + 0.2::DOUBLE * greatest(0.0, e - coalesce(lag(e) OVER (PARTITION BY source ORDER BY frame), 0)) AS feature FROM s""")
def sync_features(spark, sf_dir):
    from chronoweft.plans.views import millis

    frame = F.floor(millis("ts") / 21_600_000)
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source"), frame.alias("frame")).agg(F.sum(F.floor(F.col("value") * 100)).cast("double").alias("value"))
    return inventory.sync_features(rows, ["source"])
