"""Rows without an id, and more languages than the matrix has room for at full width."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweft.llm import fingerprints, language_id, oracles, packing, piece_bpe, quality_cotraining, queries, repeated_lines, toxicity
from oracle import assert_same

TEXT = "the report that was with them from this point which they had about there and then "


def rows(spark, n=6):
    odd = [(None, TEXT + "one two three"), (None, TEXT + "one two three"), (None, None), (None, ""), (1, None)]
    return spark.createDataFrame([*odd, *((k, TEXT * 2 + f"number {k}") for k in range(2, n))], "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))


@pytest.mark.parametrize("most", [2, 100])
def test_lines_of_rows_without_an_id(spark, tmp_path, most):
    """All rows without an id count as one document, in the query as in the SQL."""
    line = "a line that all of them have\n"
    data = [(k, line + f"word{k} " * 60) for k in range(most)] + [(None, line + "other " * 3 + " ".join(f"v{k}" for k in range(60)))] * 2
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("source", F.lit("s"))
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    if most == 100:
        got = queries.op4_repeated_lines(spark, str(tmp_path))
        db = duckdb.connect()
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert_same(got, db, oracles.OP4)
    got = repeated_lines.verdicts(df, most_documents=most).agg(F.sum("removed_words")).first()[0]
    assert got == 7 * (most + 2)
    assert repeated_lines.verdicts(df, most_documents=most + 1).agg(F.sum("removed_words")).first()[0] == 0


def test_classifiers_take_rows_without_an_id(spark):
    df = rows(spark)
    labels = spark.createDataFrame([(None, 1, 1), (2, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    language = language_id.fit(df)
    for got in (language_id.predict(df, language), toxicity.predict(df, toxicity.fit(df, labels, language)), quality_cotraining.predict(df, quality_cotraining.fit(df, labels))):
        assert got.count() == df.count() and got.filter("doc_id IS NULL").count() == 4 and got.filter("score IS NULL").isEmpty()


def test_texts_of_rows_without_an_id(spark):
    df = rows(spark)
    public = pytest.importorskip("public_tokenizers")
    pieces = piece_bpe.digests(df, piece_bpe.read_model(public.path("piece_bpe_32k.model")))
    assert pieces.count() == df.count() and pieces.filter("doc_id IS NULL").select("ids_sha256").distinct().count() == 2
    packed = packing.pack(df, queries.tokenizer_json())
    assert packed.filter("start = 0").count() == df.count()
    assert fingerprints.compare_with_next(df).count() == df.count()


def test_more_languages_than_full_width(spark, monkeypatch):
    """No language is left out: the buckets become fewer instead."""
    assert language_id.bits_for(4) == language_id.bits_for(256) == 16 and language_id.bits_for(257) == 15 and language_id.bits_for(10**6) == 8
    monkeypatch.setattr(language_id, "MOST_CELLS", 1 << 15)
    letters = "abcdefghijklmnopqrstuvwxyz"
    data = [(10 * k + j, " ".join(letters[k] * 3 + letters[(k + j) % 26] + letters[k // 2] * 2 for j in range(j, j + 9)), f"l{k:02}") for k in range(26) for j in range(5)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert model.log_probability.shape == (26, (1 << 10) + 1) and model.log_probability.dtype == np.float32
    right = language_id.predict(df, model, keep=("doc_id", "lang")).filter("lang = lang_pred").count()
    assert right >= 0.95 * len(data)
