"""The corpus pipeline: language ID, toxicity, near-duplicate removal, packing. Part of chronoweft.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Models are trained on the rows
that are not held out. The result has one row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweft.llm import language_id, ngram_join, packing, queries, toxicity
from chronoweft.llm.common import held_out, materialize


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is undetermined or uncertain."""
    return language_id.keep_identified(docs, language_id.fit(docs.filter(~held_out())))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score 0.5 or more."""
    return toxicity.keep_clean(docs, queries.toxicity_model(spark, sf_dir, docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near-duplicates."""
    return ngram_join.keep_one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack(docs, queries.tokenizer_json())


STAGES = [("language_id", language_stage), ("toxicity", toxicity_stage), ("ngram_join", near_duplicate_stage), ("packing", packing_stage)]
#: SQL expresses neither trained models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each reads what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
