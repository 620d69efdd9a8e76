"""The opN queries and the pipeline on the small test tables."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import corpus_pipeline
from chronoweft.llm import language_id, ngram_join, oracles, packing, queries, toxicity
from chronoweft.llm.common import held_out
from oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), connect(SF), SQL[name])


@pytest.mark.parametrize("name", ["op1_quality_cotraining", "op2_language_id", "op9_toxicity"])
def test_classifiers_cover_all(spark, name):
    got = QUERIES[name](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.count() == docs.count() and got.filter("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    assert got.join(docs.select("doc_id", held_out().alias("h")), "doc_id").filter("held_out <> h").isEmpty()


def test_tool_calls_of_every_turn(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    got = QUERIES["op3_tool_calls"](spark, SF).cache()
    assert got.count() + got.filter("status = 'linked'").count() == turns.count()
    assert got.filter("status = 'other_role'").count() == turns.filter("role = 'system'").count() > 0


def test_tool_calls_of_odd_turns(spark, tmp_path):
    """Repeated turns, null keys, roles and texts: every turn has its row, in the query as in the SQL."""
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "q"), (1, 1, "user", "q"), (1, 1, "user", None), (1, 2, "assistant", "b"), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (1, 3, "user", None)]
    rows += [(1, 4, "assistant", None), (2, 7, "assistant", "orphan"), (2, 9, "user", ""), (None, 1, "user", "no key"), (2, None, "user", "no turn"), (2, None, "assistant", "no turn"), (3, 1, None, "who"), (None, None, None, None), (3, 3, "user", 'a "quoted" é\n')]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op3_tool_calls"](spark, str(tmp_path))
    assert got.count() + got.filter("status = 'linked'").count() == len(rows)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert_same(got, db, SQL["op3_tool_calls"])


def test_pipeline_stages(spark):
    """Each stage against its operator on its own input; packing holds exactly what is left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "ngram_join", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count()
        assert kept.select("doc_id").subtract(before.select("doc_id")).isEmpty()
        if name == "language_id":
            rejected = language_id.predict(before, language_id.fit(before.filter(~held_out()))).filter("lang_pred = 'und' OR score < 0.5")
            assert before.count() - kept.count() == rejected.count()
        if name == "toxicity":
            rejected = toxicity.predict(before, queries.toxicity_model(spark, SF, before)).filter("score >= 0.5")
            assert before.count() - kept.count() == rejected.count()
        if name == "ngram_join":
            classes = ngram_join.classes_of(before)
            assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in classes.select("component_id").distinct().collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r[0] for r in last.select("doc_id").distinct().collect()} == {r[0] for r in kept.select("doc_id").collect()}
    assert last.groupBy("sequence_id").sum("length").filter(f"`sum(length)` > {packing.CAPACITY}").isEmpty()
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(whole.select("doc_id", "start", "length").collect()) == sorted(last.select("doc_id", "start", "length").collect())


def test_pipeline_of_odd_rows(spark):
    """Null and repeated ids, null and empty texts, clashing columns and no rows at all, through every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = "the report that was with them from this point which they had about there and then " * 6
    odd = [(7_000_001, text + "one two three"), (7_000_001, text + "one two three"), (None, text + "four five six seven eight nine ten"), (7_000_002, ""), (None, None), (7_000_003, None)]
    rows = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    df = docs.unionByName(rows.select(*(F.col(c).cast(docs.schema[c].dataType) for c in docs.columns)))
    for c in ("component", "class", "__row", "__score", "id", "n", "salt", "place"):
        df = df.withColumn(c, F.lit("clash"))
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, SF).cache()
        assert df.columns == columns, name
    assert df.filter("doc_id = 7000001").count() == 1 and df.filter("doc_id > 7000001").isEmpty()
    last = corpus_pipeline.STAGES[-1][1](spark, df, SF)
    assert last.filter("start = 0").count() == df.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
