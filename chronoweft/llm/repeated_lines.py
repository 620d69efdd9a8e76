"""Quality rules: cross-document line frequency.

Lines are normalised (A-Z in lower case, runs of ASCII white space as one space, trimmed) and hashed. For each host
the distinct documents with a line are counted, over all documents. Lines that more than MOST_DOCUMENTS documents
of a host have are removed, and a document that loses more than MOST_REMOVED of its words is rejected, as are
documents that fail the base rules on their own text.

Cases: a null or empty text has no word and fails the base rules. A null host is a host of its own. Rows that share
an id count as one document for frequencies, and so do all rows without an id; each row has its own verdict. Other columns play no part, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import map_batches, materialize, texts_of

MOST_DOCUMENTS = 100
MOST_REMOVED = 0.5
LEAST_WORDS = 50
#: Repeated words, in hundredths of all words, above which a document fails.
MOST_REPEATED = 50
#: Bytes of frequent lines (hash and host) that may be broadcast; more are joined by shuffle, and AQE splits lines that very many rows have.
BROADCAST_BYTES = 8 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_CACHE_WORDS = 60_000
#: Longer words are held by their digest, which gives the table a bound in bytes.
_CACHE_WORD_BYTES = 64


class _Numbers(dict):
    """word -> a number of its own."""

    def __missing__(self, word: bytes) -> int:
        if len(word) > _CACHE_WORD_BYTES:
            return self[b"\n" + xxhash.xxh3_128_digest(word)]  # no word has a line feed
        self[word] = n = len(self)
        return n


def normalised(line: bytes) -> bytes:
    return b" ".join(line.translate(_LOWER).split())


def line_hash(line: bytes) -> int:
    """Signed 64-bit hash of a normalised line."""
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def repeated_words(ids: np.ndarray, numbers: int) -> int:
    """Words that lie in a window of three that occurs twice or more."""
    if len(ids) < 4:
        return 0
    if numbers < 1 << 21:
        windows = (ids[:-2] * numbers + ids[1:-1]) * numbers + ids[2:]
    else:
        _, pairs = np.unique(ids[:-2] * numbers + ids[1:-1], return_inverse=True)
        windows = pairs * numbers + ids[2:]
    _, at, n = np.unique(windows, return_inverse=True, return_counts=True)
    again = n[at] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def _measured(text: str, numbers: _Numbers) -> tuple[int, int, int, int, int, list[tuple[int, int]]]:
    """(words, code points in words, symbols, repeated lines, repeated words, (hash, words) of each distinct normalised line)."""
    data = text.encode("utf-8", "surrogatepass")
    split = data.split()
    chars = len(b"".join(split).decode("utf-8", "surrogatepass"))
    ids = np.fromiter(map(numbers.__getitem__, split), np.int64, len(split))
    seen: set[bytes] = set()
    lines: dict[int, int] = {}
    again = 0
    for line in data.split(b"\n"):
        words = line.split()
        if not words:
            continue
        again += line in seen
        seen.add(line)
        h = line_hash(b" ".join(words).translate(_LOWER))
        lines[h] = lines.get(h, 0) + len(words)
    return len(split), chars, int(_SYMBOL[np.frombuffer(data, np.uint8)].sum()), again, repeated_words(ids, len(numbers) + 1), sorted(lines.items())


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """id, host, content (hash of the text), the base counts, and `lines`, the distinct normalised lines with their words."""
    rows = docs.select(F.col(key).alias("id"), F.col(host).cast("string").alias("host"), F.xxhash64(text).alias("content"), F.col(text).alias("__text"))

    def make():
        numbers = _Numbers()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            if len(numbers) > _CACHE_WORDS:
                numbers.clear()
            got = [_measured(t, numbers) for t in texts_of(batch, "__text")]
            counts = [pa.array([g[k] for g in got], pa.int64()) for k in range(5)]
            flat = [x for g in got for x in g[5]]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(g[5]) for g in got])]), pa.int32())
            pairs = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int32())], ["h", "words"])
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "host", "content")), *counts, pa.ListArray.from_arrays(offsets, pairs)], ["id", "host", "content", *_COUNTS, "lines"])

        return one

    return map_batches(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, host string, content long, {', '.join(f'{c} long' for c in _COUNTS)}, lines array<struct<h:long,words:int>>", rows=256)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def frequent_lines(measured: DataFrame, most_documents: int = MOST_DOCUMENTS) -> DataFrame:
    """(host, h, documents) of the lines that more than most_documents documents of a host have."""
    lines = measured.select("host", "id", F.explode("lines.h").alias("h")).distinct()
    return lines.groupBy("host", "h").agg(F.count("*").alias("documents")).filter(F.col("documents") > most_documents)


def verdicts(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", most_documents: int = MOST_DOCUMENTS) -> DataFrame:
    """The base counts of each row, base_failed, removed_words, removed (hashes of its removed lines) and kept."""
    measured = materialize(measure(docs, text, key, host).withColumn("row", F.monotonically_increasing_id()), "lines-measured")
    frequent = materialize(frequent_lines(measured, most_documents), "lines-frequent")
    size = frequent.agg(F.count("*").alias("n"), F.sum(F.octet_length("host")).alias("bytes")).first()
    lines = measured.select("row", "host", F.inline("lines"))
    few = F.broadcast(frequent) if 16 * size["n"] + (size["bytes"] or 0) <= BROADCAST_BYTES else frequent
    hit = lines.join(few, lines["host"].eqNullSafe(few["host"]) & (lines["h"] == few["h"])).select("row", lines["h"], "words")
    lost = hit.groupBy("row").agg(F.sum("words").alias("removed_words"), F.sort_array(F.collect_list("h")).alias("removed"))
    joined = measured.drop("lines").join(lost, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = joined.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("removed_words") <= F.col("n_words") * MOST_REMOVED))
    return judged.select(F.col("id").alias(key), *_COUNTS, "base_failed", "removed_words", "removed", "kept", "host", "content")


def cleaned(docs: DataFrame, judged: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """The kept documents without their removed lines; the columns of docs."""
    same = [F.col(key).alias("__key"), F.col("host").alias("__host"), F.col("content").alias("__content")]
    kept = judged.filter("kept").select(*same, F.coalesce("removed", F.array().cast("array<long>")).alias("__removed")).dropDuplicates(["__key", "__host", "__content"])
    on = docs[key].eqNullSafe(F.col("__key")) & docs[host].cast("string").eqNullSafe(F.col("__host")) & (F.xxhash64(docs[text]) == F.col("__content"))
    rows = docs.join(kept, on)
    columns = docs.columns

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for t, gone in zip(texts_of(batch, text), batch.column("__removed").to_pylist(), strict=True):
                gone = set(gone)
                out.append("\n".join(x for x in t.split("\n") if not gone or line_hash(normalised(x.encode("utf-8", "surrogatepass"))) not in gone))
            return pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else batch.column(c) for c in columns], columns)

        return one

    return map_batches(rows.select(*columns, "__removed"), make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
