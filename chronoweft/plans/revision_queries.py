"""Queries that edit nested documents, and that follow states through graphs of stages and receipts."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.operators import revisions, stages
from chronoweft.plans.registry import query
from chronoweft.plans.views import table


@query("revised_documents", """WITH l AS (SELECT l_orderkey AS k, l_partkey AS p, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem),
g AS (SELECT k, string_agg('{"number":' || n || ',"part":' || CASE WHEN i = 1 AND k % 8 = 1 THEN -1 ELSE p END || '}', ',' ORDER BY i) AS lines FROM l GROUP BY k),
j AS (SELECT o_orderkey, o_custkey, o_orderstatus AS s, o_orderkey % 4 = 3 AS stale, o_orderkey % 8 = 5 AND k IS NOT NULL AS overlap, lines FROM orders LEFT JOIN g ON k = o_orderkey),
d AS (SELECT o_orderkey, '{"customer":' || o_custkey || ',"lines":[' || coalesce(lines, '') || '],"status":"' || CASE WHEN stale OR overlap THEN s ELSE 'Z' END || '"}' AS json, CASE WHEN stale THEN 'stale' WHEN overlap THEN 'overlap' ELSE '' END AS issues FROM j)
SELECT o_orderkey, json, sha256(json) AS digest, issues FROM d""")
def revised_documents(spark, sf_dir):
    """Orders with their lines as documents; most get a new status, some another part, some have patches that are stale or overlap."""
    key = F.col("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part")))).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").withColumn("lines", F.coalesce("lines", F.expr("cast(array() AS array<struct<number:bigint,part:bigint>>)")))
    documents = orders.select(key, F.to_json(F.struct(F.col("o_orderstatus").alias("status"), "lines", F.col("o_custkey").alias("customer"))).alias("json"))
    patch = lambda n, path, before, after: F.struct(F.lit(n).alias("number"), F.lit(path).alias("path"), before.alias("before"), after.alias("after"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    first = F.col("lines")[0]
    every = [
        patch(1, "$.status", F.when(key % 4 == 3, F.lit('"X"')).otherwise(quoted(F.col("o_orderstatus"))), F.lit('"Z"')),
        F.when((F.size("lines") > 0) & (key % 4 == 1), patch(2, "$.lines[0].part", first["part"].cast("string"), F.lit("-1"))),
        F.when((F.size("lines") > 0) & (key % 8 == 5), patch(3, "$.lines[0]", F.to_json(first), F.lit("{}"))),
    ]
    patches = orders.select(key, F.explode(F.array_compact(F.array(*every))).alias("x")).select(key, "x.*")
    return revisions.revised(documents, patches, ["o_orderkey"])


_REACH = "r AS (SELECT up, down FROM e UNION SELECT r.up, e.down FROM r JOIN e ON r.down = e.up)"


@query("stage_manifest", f"""WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < -900 THEN 3 WHEN c_acctbal < -700 THEN 2 ELSE 1 END AS s FROM customer),
e0 AS (SELECT id // 3 AS up, id AS down FROM n UNION ALL SELECT id * 3, id FROM n WHERE id % 50 = 7 UNION ALL SELECT id, id FROM n WHERE id % 90 = 11), e AS (SELECT DISTINCT up, down FROM e0 SEMI JOIN n ON up = n.id),
{_REACH}, c AS (SELECT a.up AS id, greatest(a.up, max(b.down) FILTER (b.up IS NOT NULL)) AS cycle FROM r a LEFT JOIN r b ON b.up = a.up AND EXISTS (SELECT 1 FROM r q WHERE q.up = b.down AND q.down = b.up) WHERE a.up = a.down GROUP BY a.up),
w AS (SELECT n.id, n.s, CASE WHEN c.id IS NOT NULL THEN 3 ELSE n.s END AS own, cycle FROM n LEFT JOIN c USING (id)),
a AS (SELECT w.id, u.own, u.id AS cause FROM w JOIN w u ON u.id = w.id UNION ALL SELECT w.id, u.own, u.id FROM w JOIN r ON r.down = w.id JOIN w u ON u.id = r.up),
b AS (SELECT id, own, cause FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY own DESC, cause) = 1)
SELECT w.id, ['ready', 'warn', 'blocked'][s] AS status, ['ready', 'warn', 'blocked'][b.own] AS effective, cause, cycle FROM w JOIN b USING (id)""")
def stage_manifest(spark, sf_dir):
    """Customers as stages, each depending on a third of its number; some depend on one that depends on them, some on themselves."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < -900, "blocked").when(F.col("c_acctbal") < -700, "warn").otherwise("ready").alias("status"))
    i = F.col("id")
    edges = c.select(F.floor(i / 3).alias("up"), i.alias("down")).unionByName(c.filter(i % 50 == 7).select((i * 3).alias("up"), i.alias("down"))).unionByName(c.filter(i % 90 == 11).select(i.alias("up"), i.alias("down")))
    return stages.manifest(c, edges)


@query("receipt_chains", f"""WITH RECURSIVE d AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS digest FROM documents), k AS (SELECT id, id // 4 AS cites FROM d WHERE id > 0 UNION ALL SELECT id, id + 1000000 FROM d WHERE id % 211 = 5 UNION ALL SELECT id, id - 1 FROM d WHERE id % 3 = 1),
l AS (SELECT k.id, k.cites, coalesce(d.id IS NOT NULL AND k.id % 97 <> 13, FALSE) AS holds, d.id IS NOT NULL AS known FROM k LEFT JOIN d ON d.id = k.cites),
e AS (SELECT DISTINCT cites AS up, id AS down FROM l WHERE known), {_REACH}, o AS (SELECT d.id, count(*) FILTER (NOT holds) AS broken FROM d LEFT JOIN l ON l.id = d.id GROUP BY d.id),
t AS (SELECT r.down AS id, min(o.id) AS cause FROM r JOIN o ON o.id = r.up AND o.broken > 0 GROUP BY r.down)
SELECT o.id, CASE WHEN broken > 0 THEN 'broken' WHEN cause IS NOT NULL THEN 'tainted' ELSE 'sound' END AS state, CASE WHEN broken > 0 THEN least(o.id, coalesce(cause, o.id)) ELSE cause END AS rests_on, broken FROM o LEFT JOIN t USING (id)""")
def receipt_chains(spark, sf_dir):
    """Documents that cite others by digest; some digests are those of other texts, some cited documents don't exist."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    i = F.col("id")
    cites = [d.filter("id > 0").select(i, F.floor(i / 4).alias("cites")), d.filter(i % 211 == 5).select(i, (i + 1_000_000).alias("cites")), d.filter(i % 3 == 1).select(i, (i - 1).alias("cites"))]
    cited = cites[0].unionByName(cites[1]).unionByName(cites[2]).join(d.select(F.col("id").alias("cites"), "digest"), "cites", "left")
    tampered = cited.withColumn("digest", F.when((i % 97 != 13) & F.col("digest").isNotNull(), F.col("digest")).otherwise(F.lit("0" * 64)))
    return stages.receipts(d, tampered)
