"""Document fingerprints: quartile bucket digests.

Byte triplets of a sliding window of five bytes are hashed into buckets and counted. A digest encodes, bucket by
bucket, in which quartile of all buckets its count lies (two bits each), and in its head the logarithm of the
length and how the quartiles relate. Two digests are compared by a score of differences that is bounded, which
gives a likeness from 0 to 1.

Cases: a null or empty text has a digest of zero counts; equal texts have equal digests. For the next document
rows are ordered by key and then by text, so repeated keys follow each other; a table of one row is its own next
document. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import map_batches, small_batches, texts_of

BUCKETS = 128
#: Places in the window of a newest byte and two older ones; each triplet has a factor of its own.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
#: Differences of the whole digest that count as no likeness at all: what unrelated texts come to.
MOST_DIFFERENCE = 160.0
#: Ranges of the key for each task: they are dealt to tasks by hash, so several even out.
RANGES_PER_TASK = 4
_FACTORS = (0x9E37, 0x85EB, 0xC2B3)
_SALTS = (0x632D, 0x27D5, 0x1657, 0xB5D9, 0x4CF7, 0xE995)
_STEP_COST = np.array([0, 1, 2, 6])


def bucket_counts(data: bytes) -> np.ndarray:
    """Counts of the hashed triplets of all windows of a text; shorter windows at its start count too."""
    if not data:
        return np.zeros(BUCKETS, np.int64)
    n = len(data)
    b = np.frombuffer(b"\0\0\0\0" + data, np.uint8).astype(np.uint16)
    total = np.zeros(BUCKETS, np.int64)
    newest, second, third = (b * np.uint16(factor) for factor in _FACTORS)
    for salt, (x, y, z) in enumerate(TRIPLETS):
        h = newest[4 - x : 4 - x + n] + second[4 - y : 4 - y + n]
        h ^= h >> np.uint16(5)
        h += third[4 - z : 4 - z + n]
        h *= np.uint16(_SALTS[salt])
        h ^= h >> np.uint16(8)
        total += np.bincount((h * np.uint16(0x9E35)) >> np.uint16(9), minlength=BUCKETS)
    return total


def digest(data: bytes) -> str:
    """Hexadecimal: two digits for the length, two for the ratios of the quartiles, then the buckets."""
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    level = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    head = min(255, int(np.log(max(len(data), 1)) * 12))
    ratios = (int(15 * q1 / q3) << 4 | int(15 * q2 / q3)) if q3 else 0
    codes = level.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.int64)
    return bytes([head, ratios, *codes.tolist()]).hex()


def difference(a: str, b: str) -> int:
    """Score of differences of two digests: 0 if they are equal; far quartiles cost more than near ones."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    length = abs(int(x[0]) - int(y[0]))
    ratio = abs((int(x[1]) >> 4) - (int(y[1]) >> 4)) + abs((int(x[1]) & 15) - (int(y[1]) & 15))
    steps = sum(_STEP_COST[np.abs((x[2:].astype(int) >> s & 3) - (y[2:].astype(int) >> s & 3))].sum() for s in (0, 2, 4, 6))
    return int(max(0, length - 1) + ratio + steps)


def likeness(a: str, b: str) -> float:
    return 1.0 - min(difference(a, b), MOST_DIFFERENCE) / MOST_DIFFERENCE


def fingerprint(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and `fingerprint` of each whole text."""
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))

    def make():
        return lambda b: pa.RecordBatch.from_arrays([b.column("__key"), pa.array([digest(t.encode("utf-8", "replace")) for t in texts_of(b, "__text")], pa.string())], [key, "fingerprint"])

    return map_batches(rows, make, f"`{key}` {rows.schema['__key'].dataType.simpleString()}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of a text (rounded down) replaced by as many code points from the start of the following one, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and their likenesses. One shuffle of the texts, by ranges of the key.

    Each range also gets a copy of the first document of the next one; the last gets the first of all.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = rows.agg(F.count("*").alias("n"), F.count("key").alias("known")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(RANGES_PER_TASK * tasks, counted["n"]))
    cuts = sorted(set(rows.select("key").approxQuantile("key", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 and counted["known"] else []
    bounds = np.array([int(c) for c in cuts], np.int64)

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(np.int64), "right").astype(np.int32))

    ranged = rows.withColumn("part", part_of(F.coalesce("key", F.lit(int(np.iinfo(np.int64).min)))))
    # The smallest key of each range, and so many as there are ranges: the range before needs that document.
    first = {r["part"]: r["least"] for r in ranged.groupBy("part").agg(F.min("key").alias("least")).collect()}
    order = sorted(first)
    wanted = [(order[k - 1], first[p]) for k, p in enumerate(order)]  # the last range needs the first document of all
    low = np.iinfo(np.int64).min
    copies_of = {low if least is None else least: part for part, least in wanted}

    @F.pandas_udf("int")
    def copy_for(key: pd.Series) -> pd.Series:
        return key.map(copies_of).astype("Int32")

    copy = copy_for(F.coalesce("key", F.lit(int(low))))
    last_part = order[-1] if order else 0
    copies = ranged.withColumn("part", copy).filter("part IS NOT NULL").withColumn("kind", F.when(F.col("part") == last_part, 2).otherwise(1))
    dealt = ranged.withColumn("kind", F.lit(0)).unionByName(copies).repartition(tasks, "part").sortWithinPartitions("part", "kind", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # (part, key, text, digest)
        out: list[tuple] = []

        def done(row: tuple, following: str, following_digest: str) -> tuple:
            made = edited(row[2], following).encode("utf-8", "replace")
            again = digest(made)
            return row[1], len(row[2]), hashlib.sha256(made).hexdigest(), row[3], again, likeness(row[3], again), likeness(row[3], following_digest)

        def batch_of(got: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate(kinds)], [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for part, k, t, kind in zip(batch.column("part").to_pylist(), batch.column("key").to_pylist(), batch.column("text"), batch.column("kind").to_pylist(), strict=True):
                own = t.as_py()
                mark = digest(own.encode("utf-8", "replace"))
                if before is not None and before[0] == part:
                    out.append(done(before, own, mark))
                before = (part, k, own, mark) if kind == 0 else None
                if len(out) >= 256:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    return dealt.select("part", "key", "text", "kind").mapInArrow(run, f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
