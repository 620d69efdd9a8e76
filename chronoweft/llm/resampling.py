"""Importance resampling towards a target: documents are drawn without replacement, the likelier the more their hashed n-grams look like the target's.

Features of a text are all runs of one to three consecutive terms. Terms are mapped to integers by a dictionary, n-grams are tuples
of these; of each distinct tuple of a portion of texts the bytes go through crc32 once (a tuple's last term is hashed on from the crc of
the terms before it), and the bucket is joined back to every occurrence. A document is written as its sorted buckets, in differences. From that
table come the bucket counts of all documents (a fixed number of rows to the driver), the gain of each bucket and
each document's sum of gains. Gumbel noise from a hash of the key makes the draw; ranks come from a sort by ranges and the row counts of its partitions.

Cases: a null or empty text has no feature, weight 0, and is never drawn; nor are texts under `least_words` terms. A null key is
hashed as an empty one. Rows that share a key have the same noise; equal scores go to the smaller key (null last), then to the row read first.
Rows that are equal throughout are drawn one by one. No document or no target: gains follow from counts of 0. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import map_batches, materialize, small_batches, texts_of
from chronoweft.llm.terms import portions, terms

BUCKETS = 10_000
LEAST_WORDS = 20
#: Hundredths of the documents with LEAST_WORDS terms that are drawn.
DRAWN = 5
SEED = 42
_CACHE_WORDS = 100_000
_CACHE_BYTES = 8 << 20


class WordIds(dict):
    """term -> integer; with the term's crc32 and the bytes that hash it on from a tuple before it."""

    def __init__(self) -> None:
        super().__init__()
        self.crcs: list[int] = []
        self.following: list[bytes] = []
        self.held = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.crcs)
        self.crcs.append(crc32(word))
        self.following.append(b" " + word)
        self.held += len(word)
        return n

    def trim(self) -> None:
        if len(self) > _CACHE_WORDS or self.held > _CACHE_BYTES:
            self.__init__()
            self.clear()

    def hashed_on(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """crc32 of each tuple: `last` words after tuples with the crcs `before`."""
        return np.fromiter(map(crc32, map(self.following.__getitem__, last.tolist()), before.tolist()), np.uint32, len(last))


def hashed_features(texts: list[str], words: WordIds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted buckets of the features, text after text; features of each text; terms of each text)."""
    words.trim()
    split = [terms(t) for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ids = np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
    del split
    text, n = np.repeat(np.arange(len(texts)), sizes), len(words)
    crcs = np.array(words.crcs, np.uint32)
    found = [text * BUCKETS + crcs[ids] % BUCKETS]
    code, known = ids, crcs  # of the tuple that begins at each place: its number, and the crc of each number
    for order in (2, 3):
        code, at = code[:-1], np.flatnonzero(text[: 1 - order] == text[order - 1 :]) if len(ids) >= order else np.zeros(0, np.int64)
        numbers, tuples = pd.factorize(code[at] * n + ids[at + order - 1])
        known = words.hashed_on(known[tuples // max(n, 1)], tuples % max(n, 1))
        found.append(text[at] * BUCKETS + known[numbers] % BUCKETS)
        code = np.zeros(len(code), np.int64)
        code[at] = numbers
    flat = np.concatenate(found)
    flat.sort()
    return flat % BUCKETS, np.bincount(flat // BUCKETS, minlength=len(texts)), sizes


def packed(buckets: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Sorted buckets of each text as differences of two bytes."""
    steps = np.diff(buckets, prepend=0)
    starts = np.cumsum(sizes) - sizes
    first = starts[sizes > 0]
    steps[first] = buckets[first]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * 2
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(steps.astype("<u2"))])


def unpacked(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, text after text; features of each text)."""
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 2
    steps = np.frombuffer(b"".join(values), "<u2").astype(np.int64)
    total = np.cumsum(steps)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    return total - np.repeat(total[first] - steps[first], sizes[sizes > 0]), sizes


def featured(df: DataFrame, text: str = "text", key: str | None = "doc_id") -> DataFrame:
    """id (without a key: null), n_words, n_features and the packed buckets of each whole text."""
    rows = df.select((F.col(key) if key else F.lit(None).cast("long")).alias("id"), F.col(text).alias("__text"))

    def make():
        words = WordIds()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch, "__text")
            got = [(packed(b, n), n, w) for s, e in portions(texts) for b, n, w in [hashed_features(texts[s:e], words)]]
            columns = [pa.concat_arrays([g[0] for g in got]), *(pa.array(np.concatenate([g[k] for g in got]), pa.int64()) for k in (1, 2))] if got else [pa.array([], t) for t in (pa.binary(), pa.int64(), pa.int64())]
            return pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "buckets", "n_features", "n_words"])

        return one

    return map_batches(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, buckets binary, n_features long, n_words long", rows=256, operator="resampling")


def bucket_counts(features: DataFrame) -> np.ndarray:
    """Features in each bucket, over all rows; counted in each task first."""
    small_batches(features.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            total += np.bincount(unpacked(b.column("buckets").to_pylist())[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    got = features.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in got:
        counts[bucket] = n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, thousandths of the log-ratio of its smoothed shares in the target and in the source, rounded down."""
    all_source, all_target = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log(float(t + 1) * all_source / (float(s + 1) * all_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, n_words, n_features and weight, the sum of the gains of a row's features."""
    shared = features.sparkSession.sparkContext.broadcast(gain)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            buckets, sizes = unpacked(batch.column("buckets").to_pylist())
            total = np.concatenate([[0], np.cumsum(shared.value[buckets])])
            ends = np.cumsum(sizes)
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n_words", "n_features")), pa.array(total[ends] - total[ends - sizes], pa.int64())], ["id", "n_words", "n_features", "weight"])

        return one

    return map_batches(features, make, f"id {features.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long", rows=256, operator="resampling")


def ranked(df: DataFrame, *order) -> DataFrame:
    """df with `place` (0, 1, 2 ... in that order): a sort by ranges whose rows are numbered by partition, then moved by the counts of the partitions before."""
    by_range = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    done = materialize(by_range, "ranked")
    part = F.shiftright("__at", 33)
    counts = sorted(done.groupBy(part.alias("part")).count().collect())  # a row for each partition
    before, rows = 0, []
    for p, n in counts:
        rows.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(rows, "__part long, __before long")
    placed = done.join(F.broadcast(offsets), part == F.col("__part"))
    return placed.withColumn("place", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__before")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text", drawn: int = DRAWN, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Of each document: the key, n_words, n_features, weight, score, and rank, which is null unless it is drawn."""
    features = materialize(featured(docs, text, key), "features")
    gain = gains(bucket_counts(features), bucket_counts(featured(target, target_text, None)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed(features, gain).withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id())
    placed = ranked(scored.withColumn("able", F.col("n_words") >= least_words), F.desc("able"), F.desc("score"), F.asc_nulls_last("id"), F.asc("row"))
    able = placed.filter("able").count()
    rank = F.when(F.col("able") & (F.col("place") < able * drawn // 100), F.col("place") + 1)
    return placed.select(F.col("id").alias(key), "n_words", "n_features", "weight", "score", rank.alias("rank"))
