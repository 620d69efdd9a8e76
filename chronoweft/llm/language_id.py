"""Language ID: multinomial naive Bayes over hashed character n-grams.

fit() counts n-grams in Spark, brings one count matrix of a fixed size (languages x buckets) to the driver and
turns it into log-probabilities; predict() broadcasts that matrix and scores batches in numpy: the n-grams of a
batch are one sparse matrix (bucket indices and row starts), multiplied with the log-probabilities.

Cases: a null or empty text, or one without a letter, is `und` with score 0. Rows with a null language teach
nothing. Repeated rows count as often as they come; as the sample goes by a hash of the key, rows of one key are in it
together or not at all. The matrix has a row for every language and at most MOST_CELLS cells: from 256 languages on n-grams share fewer buckets, halved
until it fits, but for LEAST_BITS, below which the matrix grows by 256 cells a language. Without any labelled row every text is `und`. Ties go to the
language that sorts first. Other columns of the input are left out of the result, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import bounded_sample, fresh, map_batches, small_batches, texts_of

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
BUCKET_BITS = 16
LEAST_BITS = 8
#: Bound of the training sample: so many documents of each language, about.
SAMPLE_PER_LANGUAGE = 2000
#: Cells of the matrix at most (of four bytes each).
MOST_CELLS = 1 << 24
#: A posterior counts so many n-grams at most, as n-grams of one text are far from independent.
EVIDENCE = 60.0
_TABLE = 0x20000
#: Letters from _TABLE on are ideographs, up to here.
_IDEOGRAPHS_END = 0x323B0


@lru_cache(1)
def _folded() -> np.ndarray:
    """By code point: its lower-case letter, or a space if it is no letter."""
    table = np.full(_TABLE, 32, np.uint32)
    for c in range(_TABLE):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def bits_for(languages: int) -> int:
    """Bits of a bucket's number, so that the matrix of so many languages fits."""
    return next((b for b in range(BUCKET_BITS, LEAST_BITS, -1) if languages << b <= MOST_CELLS), LEAST_BITS)


def sparse_ngrams(texts: list[str], bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket indices by order, starts of the texts, letters of each text). The bucket after the last stands for white space."""
    glued = "  ".join(texts) + "  "
    codes = np.frombuffer(glued.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < _TABLE, _folded()[np.minimum(codes, _TABLE - 1)], np.where(codes < _IDEOGRAPHS_END, codes, 32))
    starts = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 2 for t in texts[:-1]], out=starts[1:])
    blank = codes == 32
    letters = np.add.reduceat((~blank).astype(np.int64), starts)
    grams = np.empty((len(ORDERS), len(codes)), np.int32)
    mixed, empty = codes.astype(np.uint32), blank
    for k, order in enumerate(ORDERS):
        if order > 1:
            shifted = np.roll(codes, 1 - order)
            mixed = mixed * np.uint32(0x01000193) + shifted
            empty = empty & np.roll(blank, 1 - order)
        bucket = ((mixed ^ np.uint32(order)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        grams[k] = np.where(empty, 1 << bits, bucket)
    return grams, starts, letters


@dataclass
class LanguageModel:
    languages: list[str]
    log_probability: np.ndarray  # languages x (buckets + 1), the last column 0

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text."""
        if not texts:
            return [], np.zeros(0)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        buckets = self.log_probability.shape[1] - 1
        grams, starts, letters = sparse_ngrams(texts, buckets.bit_length() - 1)
        total = np.stack([sum(np.add.reduceat(row[g], starts, dtype=np.float64) for g in grams) for row in self.log_probability], 1)
        n = np.add.reduceat((grams != buckets).sum(0), starts)
        z = total * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
        z = np.exp(z - z.max(1, keepdims=True))
        best, p = total.argmax(1), z / z.sum(1, keepdims=True)
        known = letters > 0
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], np.where(known, p[np.arange(len(texts)), best], 0.0)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learns from the rows of df that have a language and a text; a bounded sample of them (see SAMPLE_PER_LANGUAGE)."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    bits = bits_for(rows.select("lang").distinct().count())
    sample = bounded_sample(rows, "lang", sample_per_language, "key", "language").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = texts_of(batch)
            for one in sorted(set(langs)):
                grams, _, _ = sparse_ngrams([texts[i] for i in np.flatnonzero(langs == one)], bits)
                got = np.bincount(grams.ravel(), minlength=(1 << bits) + 1)
                sums[one] = sums[one] + got if one in sums else got
        for one, got in sums.items():
            at = np.flatnonzero(got[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(got[at])], ["lang", "bucket", "n"])

    got = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(got["lang"]))
    counts = np.zeros((len(languages), (1 << bits) + 1))
    if languages:
        counts[np.searchsorted(languages, got["lang"].to_numpy(str)), got["bucket"].to_numpy()] = got["n"].to_numpy()
    counts = counts[:, :-1] + 0.5
    logs = np.log(counts / counts.sum(1, keepdims=True)) if languages else counts
    logs = logs - logs.mean(0) if languages else logs
    return LanguageModel(languages, np.hstack([logs, np.zeros((len(languages), 1))]).astype(np.float32))


def predict(df: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), language: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns `keep` of df with the language of each whole text and the score of that language."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    own = text if text in keep else "__text"
    rows = df.select(*keep) if text in keep else df.select(*keep, F.col(text).alias("__text"))
    schema = [f for f in rows.schema if f.name in keep]

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, p = shared.value.score(texts_of(batch, own))
            kept = [batch.column(k) for k in keep]
            return pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(p, pa.float64())], [*keep, language, score])

        return one

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return map_batches(rows, make, f"{ddl}, `{language}` string, `{score}` double")


def keep_identified(df: DataFrame, model: LanguageModel, min_score: float = 0.5) -> DataFrame:
    """df without the documents whose language is undetermined or scores below min_score; the same columns."""
    lang, score = fresh(df, "__lang"), fresh(df, "__score")
    marked = predict(df, model, keep=tuple(df.columns), language=lang, score=score)
    return marked.filter((F.col(lang) != UNDETERMINED) & (F.col(score) >= min_score)).drop(lang, score)
