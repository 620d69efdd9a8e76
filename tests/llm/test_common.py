"""What the training-data operators share."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronoweft.llm import common, language_id
from chronoweft.llm.hashed_words import WordIndex, features, shortened


def test_bounded_sample(spark):
    rows = spark.range(6000).select(F.col("id").alias("key"), F.when(F.col("id") < 5000, "much").when(F.col("id") < 5900, "some").otherwise(None).alias("kind"))
    counts = {r["kind"]: r["count"] for r in common.bounded_sample(rows, "kind", 1000, "key", "seed").groupBy("kind").count().collect()}
    assert set(counts) == {"much", "some"} and counts["some"] == 900 and 850 < counts["much"] < 1150
    again = common.bounded_sample(rows, "kind", 1000, "key", "seed").agg(F.sum("key")).first()[0]
    assert again == common.bounded_sample(rows.repartition(7), "kind", 1000, "key", "seed").agg(F.sum("key")).first()[0]
    assert common.bounded_sample(rows.limit(0), "kind", 1000, "key", "seed").count() == 0


def test_bounded_sample_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(common, "_BROADCAST_VALUES", 10)
    rows = spark.range(900).select(F.col("id").alias("key"), (F.col("id") % 300).alias("kind"))
    assert common.bounded_sample(rows, "kind", 3, "key", "seed").count() == 900


def test_materialize(spark):
    df = spark.range(10).withColumn("x", F.lit("clash"))
    written = common.materialize(df, "test")
    assert written.dtypes == df.dtypes and written.count() == 10 and "Range" not in written._jdf.queryExecution().toString()


def test_one_label_and_held_out(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (3, 5), (4, 0)], "doc_id long, toxic long")
    assert sorted(map(tuple, common.one_label(labels, "toxic", "doc_id").collect())) == [(1, 1), (4, 0)]
    held = spark.createDataFrame([(None,), (1,)], "doc_id long").select(common.held_out().alias("h")).collect()
    assert held[0]["h"] is False


def test_one_key_for_all_rows(spark):
    """A hash of one key takes all rows or none, so a model of such rows may know nothing; it says so."""
    df = spark.createDataFrame([(7, "the words of a text", "en")] * 50, "doc_id long, text string, lang string")
    model = language_id.fit(df, sample_per_language=10)
    langs = {r["lang_pred"] for r in language_id.predict(df, model).collect()}
    assert langs in ({"en"}, {"und"})


def test_long_words():
    index = WordIndex()
    long = b"(" + b"x" * 500 + b"yz)"
    rows, sizes = index.look_up([long.decode() + " short", ""])
    assert sizes.tolist() == [2, 0] and len(index) == 2 and max(map(len, index)) <= 64
    assert shortened(b"word") == b"word" and features(long)[1:4] == features(shortened(long))[1:4]


def test_caches_of_one_operator():
    common.held_by("a")["x"] = 1
    assert common.held_by("a") == {"x": 1} and common.held_by("b") == {} and common.held_by("a") == {}


def test_fresh_names(spark):
    df = spark.range(1).withColumn("__score", F.lit(1)).withColumn("__score_", F.lit(1))
    assert common.fresh(df, "__score") == "__score__" and common.fresh(df, "other") == "other"


def test_scratch_folder_of_a_cluster(spark, monkeypatch):
    from chronoweft.operators import graph

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="share"):
        graph.scratch_dir(Session())
