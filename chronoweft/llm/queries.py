"""The thin opN_<name> queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweft.llm import fingerprints, html_consensus, language_id, lexical_search, ngram_join, packing, pii, piece_bpe, quality_cotraining, repeated_lines, resampling, tool_calls, toxicity
from chronoweft.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~held_out()))
    out = language_id.predict(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_cotraining.fit(docs.filter(~held_out()), _table(spark, sf_dir, "labels").filter(~held_out()))
    out = quality_cotraining.predict(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", "text_score", "metadata_score", (F.col("score") >= 0.5).alias("kept"))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.ToxicityModel:
    """Trained on the labelled rows of docs that aren't held out; the language of a text is predicted from the text."""
    learned = docs.filter(~held_out())
    return toxicity.fit(learned, _table(spark, sf_dir, "labels").filter(~held_out()), language_id.fit(learned))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.predict(docs, toxicity_model(spark, sf_dir, docs))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_piece_bpe(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return piece_bpe.digests(_table(spark, sf_dir, "documents"), piece_bpe.read_model(model or public_tokenizers.path("piece_bpe_32k.model")))


def tokenizer_json(path: str | None = None) -> str:
    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op7_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_json(tokenizer))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(_table(spark, sf_dir, "documents"))


def op4_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_lines.verdicts(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op5_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_consensus.extract(_table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every turn that isn't the result in a call's row: calls, orphan results, duplicates, turns without a key, other roles."""
    turns = _table(spark, sf_dir, "conversations")
    return tool_calls.link_all(tool_calls.calls_of_turns(turns), tool_calls.results_of_turns(turns), tool_calls.TURN_SCHEMAS, tool_calls.others_of_turns(turns))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes_of(_table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = pii.find(docs, pii.fit(docs.filter(~held_out())))
    joined = lambda found: F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    base = F.sha2(joined(F.filter("found", lambda x: ~x["added"])).cast("binary"), 256)
    return out.select("doc_id", *(f"n_{k}" for k in pii.KINDS), base.alias("base_sha256"), joined(F.col("found")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_cotraining": op1_quality_cotraining,
        "op2_language_id": op2_language_id,
        "op3_tool_calls": op3_tool_calls,
        "op4_repeated_lines": op4_repeated_lines,
        "op5_html_consensus": op5_html_consensus,
        "op6_piece_bpe": op6_piece_bpe,
        "op7_packing": op7_packing,
        "op8_fingerprints": op8_fingerprints,
        "op9_toxicity": op9_toxicity,
        "op10_ngram_join": op10_ngram_join,
        "op11_resampling": op11_resampling,
        "op12_lexical_search": op12_lexical_search,
        "op13_pii": op13_pii,
    }
