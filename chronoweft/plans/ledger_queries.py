"""Queries over ledgers, gates and revisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.operators import ledger
from chronoweft.plans.registry import query
from chronoweft.plans.views import table


@query("status_machine", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 1000 THEN 'ready' WHEN o_orderstatus = 'F' THEN 'review' WHEN o_orderstatus = 'P' THEN 'waiting' ELSE 'blocked' END AS readiness FROM orders""")
def status_machine(spark, sf_dir):
    s = ledger.alias(F.col("o_orderstatus"), {"f": "finished", "p": "pending"})
    rules = [((s == "finished") & (F.col("o_totalprice") > 1000), "ready"), (s == "finished", "review"), (s == "pending", "waiting")]
    return table(spark, sf_dir, "orders").select("o_orderkey", ledger.decided(rules, "blocked").alias("readiness"))


_ARTIFACTS = """a AS (SELECT l_orderkey AS subject, l_returnflag AS category, CASE WHEN l_linestatus = 'F' AND l_quantity > 45 THEN 'blocked' WHEN l_quantity > 40 THEN 'review' ELSE 'ready' END AS status FROM lineitem)"""


def _artifacts(spark, sf_dir):
    status = F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45), "blocked").when(F.col("l_quantity") > 40, "review").otherwise("ready")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject"), F.col("l_returnflag").alias("category"), status.alias("status"))


@query("gate_rollup", f"""WITH {_ARTIFACTS}, c AS (SELECT subject, category, bool_or(status = 'blocked') AS b, bool_or(status = 'review') AS w FROM a GROUP BY ALL), q AS (SELECT DISTINCT subject, k AS category FROM a, (VALUES ('R'), ('N')) v(k)),
r AS (SELECT q.subject, count(*) FILTER (b IS NULL) AS missing, count(*) FILTER (b) AS blocked, count(*) FILTER (w AND NOT b) AS warned FROM q LEFT JOIN c USING (subject, category) GROUP BY q.subject)
SELECT *, CASE WHEN missing > 0 OR blocked > 0 THEN 'blocked' WHEN warned > 0 THEN 'review' ELSE 'ready' END AS status FROM r""")
def gate_rollup(spark, sf_dir):
    a = _artifacts(spark, sf_dir)
    required = a.select("subject").distinct().withColumn("category", F.explode(F.array(F.lit("R"), F.lit("N"))))
    return ledger.gate(a, required, ["subject"])


_FILES = """e AS (SELECT p_partkey AS path, p_size AS size FROM part WHERE p_partkey % 7 <> 0), a AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS size FROM part WHERE p_partkey % 11 <> 0)"""


def _files(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    expected = p.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("size"))
    actual = p.filter("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size"))
    return expected, actual


@query("verify_receipt", f"""WITH {_FILES} SELECT coalesce(e.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'extra' WHEN e.size <> a.size THEN 'changed' ELSE 'same' END AS verdict FROM e FULL JOIN a ON e.path = a.path""")
def verify_receipt(spark, sf_dir):
    return ledger.compared(*_files(spark, sf_dir), ["path"], "size")


@query("repeated_keys", "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return ledger.repeated(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"])


@query("orphan_references", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphan_references(spark, sf_dir):
    return ledger.orphans(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").filter("lang = 'en'"), ["doc_id"])


@query("set_audit", """WITH e AS (SELECT DISTINCT l_orderkey AS subject, l_linenumber AS item FROM lineitem WHERE l_quantity > 10), f AS (SELECT l_orderkey AS subject, CAST(l_linenumber % 4 AS INTEGER) AS item, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT coalesce(e.subject, f.subject) AS subject, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (e.subject IS NULL) AS unexpected, count(*) FILTER (n > 1) AS repeated FROM e FULL JOIN f ON e.subject = f.subject AND e.item = f.item GROUP BY 1""")
def set_audit(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    expected = i.filter("l_quantity > 10").select(F.col("l_orderkey").alias("subject"), F.col("l_linenumber").alias("item"))
    return ledger.set_audit(expected, i.select(F.col("l_orderkey").alias("subject"), (F.col("l_linenumber") % 4).alias("item")), ["subject"], "item")


_HISTORY = """h AS (SELECT o_custkey AS artifact, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, o_orderkey AS after, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)"""


def _history(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("artifact"), F.row_number().over(w).alias("seq"), F.col("o_orderkey").alias("after"), F.lag("o_orderkey").over(w).alias("before"))


@query("state_at_cursor", f"""WITH {_HISTORY}, x AS (SELECT * FROM h WHERE artifact % 3 = 0 OR seq > 5) SELECT artifact, CASE WHEN count(*) FILTER (seq <= 4) > 0 THEN arg_max(after, seq) FILTER (seq <= 4) ELSE arg_min(before, seq) FILTER (seq > 4) END AS state FROM x GROUP BY artifact""")
def state_at_cursor(spark, sf_dir):
    return ledger.state_at(_history(spark, sf_dir).filter("artifact % 3 = 0 OR seq > 5"), ["artifact"], 4)


@query("broken_chain", f"""WITH {_HISTORY}, x AS (SELECT * FROM h WHERE NOT (artifact % 10 = 0 AND seq = 3)), n AS (SELECT *, row_number() OVER w AS n, lag(after) OVER w AS prev FROM x WINDOW w AS (PARTITION BY artifact ORDER BY seq))
SELECT artifact, CAST(seq AS INTEGER) AS seq, after, before FROM n WHERE seq <> n OR (n > 1 AND before IS DISTINCT FROM prev)""")
def broken_chain(spark, sf_dir):
    return ledger.broken_chain(_history(spark, sf_dir).filter("NOT (artifact % 10 = 0 AND seq = 3)"), ["artifact"])


@query("select_lessons", """WITH e AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'p' WHEN 1 THEN '*' ELSE 'q' END AS provider, CASE p_partkey % 2 WHEN 0 THEN 'm' ELSE '*' END AS model, p_partkey - 6 AS old, p_size AS day FROM part), m AS (SELECT * FROM e WHERE provider IN ('p', '*') AND model IN ('m', '*'))
SELECT id, provider, model FROM m WHERE id NOT IN (SELECT old FROM m WHERE id % 4 = 0) ORDER BY provider = 'p' DESC, model = 'm' DESC, day DESC, id LIMIT 30""")
def select_lessons(spark, sf_dir):
    k = F.col("p_partkey")
    provider = F.when(k % 3 == 0, "p").when(k % 3 == 1, "*").otherwise("q")
    entries = table(spark, sf_dir, "part").select(k.alias("id"), provider.alias("provider"), F.when(k % 2 == 0, "m").otherwise("*").alias("model"), F.when(k % 4 == 0, F.array(k - 6)).otherwise(F.array().cast("array<bigint>")).alias("supersedes"), F.col("p_size").alias("day"))
    return ledger.lessons(entries, "p", "m", 30).select("id", "provider", "model")


@query("canonical_digest", """SELECT p_partkey, sha256('{"brand":' || CAST(to_json(p_brand) AS VARCHAR) || ',"name":' || CAST(to_json(p_name) AS VARCHAR) || ',"size":' || p_size || '}') AS digest FROM part""")
def canonical_digest(spark, sf_dir):
    fields = [F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size")]
    return table(spark, sf_dir, "part").select("p_partkey", ledger.digest(fields).alias("digest"))


@query("freshness", """SELECT o_orderkey, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-06-30') < 0 THEN 'future' WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-06-30') > 365 THEN 'stale' ELSE 'fresh' END AS freshness FROM orders""")
def freshness(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", ledger.freshness(F.to_date("o_orderdate"), F.lit("1996-06-30").cast("date"), 365).alias("freshness"))


@query("coverage_by_label", """SELECT lang, quality, toxic, count(*) AS n, count(DISTINCT source) AS sources FROM documents JOIN labels USING (doc_id) GROUP BY ALL""")
def coverage_by_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))
