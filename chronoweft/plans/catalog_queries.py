"""Queries over the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.operators import catalog
from chronoweft.plans.registry import query
from chronoweft.plans.views import table


@query("catalog_upsert", """WITH a AS (SELECT p_partkey AS id, p_name AS name, p_size AS version, 0 AS side FROM part), b AS (SELECT p_partkey, upper(p_name), CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size - 1 END, 1 FROM part WHERE p_partkey % 3 = 0),
n AS (SELECT p_partkey + 10000000, p_name, p_size, 1 FROM part WHERE p_partkey % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, side DESC) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM n))
SELECT id, name, version FROM r WHERE k = 1""")
def catalog_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("version"))
    newer = old.filter("id % 3 = 0").select("id", F.upper("name").alias("name"), F.when(F.col("id") % 2 == 0, F.col("version")).otherwise(F.col("version") - 1).alias("version"))
    added = old.filter("id % 100 = 0").withColumn("id", F.col("id") + 10_000_000)
    return catalog.upsert(old, newer.unionByName(added), ["id"], "version")


@query("ledger_merge", """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN p_size + 1 ELSE p_size END AS size FROM part""")
def ledger_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    old = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    new = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise("").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") + 1).alias("size"))
    return catalog.merged_rows(old, new, ["id"])


@query("catalog_remove", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def catalog_remove(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return catalog.removed(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), gone, ["c_custkey"])


@query("catalog_search", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%d_r%' OR lower(p_type) LIKE '%d_r%' OR lower(p_brand) LIKE '%d_r%'")
def catalog_search(spark, sf_dir):
    return catalog.search(table(spark, sf_dir, "part"), ["p_name", "p_type", "p_brand"], "d_r").select("p_partkey", "p_name")


@query("catalog_search_joined", "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_type), 'g econ')")
def catalog_search_joined(spark, sf_dir):
    return catalog.search(table(spark, sf_dir, "part"), ["p_name", "p_type"], "g econ", wildcards=False).select("p_partkey")


@query("media_kinds", """WITH f AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'a.MP4' WHEN 1 THEN 'b.wav' WHEN 2 THEN 'c.jpeg' WHEN 3 THEN 'd.txt' ELSE 'none' END AS path FROM part)
SELECT CASE path WHEN 'a.MP4' THEN 'video' WHEN 'b.wav' THEN 'audio' WHEN 'c.jpeg' THEN 'image' ELSE 'other' END AS kind, count(*) AS n FROM f GROUP BY 1""")
def media_kinds(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, ("a.MP4", "b.wav", "c.jpeg", "d.txt", "none"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").groupBy(catalog.media_kind(path).alias("kind")).agg(F.count("*").alias("n"))


@query("recommend_assets", """WITH s AS (SELECT p_partkey, p_name, (CASE WHEN contains(lower(p_name), 'bolt') THEN 3.0 ELSE 0 END + CASE WHEN contains(lower(p_name), 'small') THEN 3.0 ELSE 0 END + CASE WHEN list_contains(string_split(lower(p_type), ' '), 'small') THEN 2.0 ELSE 0 END + CASE WHEN list_contains(string_split(lower(p_type), ' '), 'bolt') THEN 2.0 ELSE 0 END + greatest(0.0, 1 - abs(p_size - 20) / 20.0::DOUBLE))::DOUBLE AS score, abs(p_size - 20.0)::DOUBLE AS delta FROM part)
SELECT p_partkey, score FROM s WHERE score > 0 ORDER BY score DESC, delta, p_name, p_partkey LIMIT 25""")
def recommend_assets(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("tags", F.split("p_type", " "))
    return catalog.recommended(p, ["bolt", "small"], "p_name", "tags", "p_size", 20.0, 25, ["p_partkey"]).select("p_partkey", "score")


@query("best_of_each", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def best_of_each(spark, sf_dir):
    tier = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return catalog.best_of_each(table(spark, sf_dir, "orders"), ["o_custkey"], tier, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("running_budget", """WITH c AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
SELECT o_custkey, o_orderkey, CAST(sum(cents) OVER w AS BIGINT) AS spent, sum(cents) OVER w <= 100000000 AS within FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def running_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return catalog.running_budget(rows, ["o_custkey"], ["o_orderkey"], "cents", 100_000_000).select("o_custkey", "o_orderkey", "spent", "within")


@query("keyed_lookup", """WITH t AS (SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS v FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'r' || r_regionkey, r_name FROM region WHERE r_regionkey < 3)
SELECT c_custkey, coalesce(a.v, b.v) AS found FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN t a ON a.key = CAST(c_nationkey AS VARCHAR) LEFT JOIN t b ON b.key = 'r' || n_regionkey""")
def keyed_lookup(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    names = nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("v"))
    regions = table(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("key"), F.col("r_name").alias("v"))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return catalog.keyed_lookup(c, names.unionByName(regions), [F.col("c_nationkey").cast("string"), F.concat(F.lit("r"), F.col("n_regionkey"))], "v").select("c_custkey", "found")
