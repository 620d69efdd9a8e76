"""Ranked lexical search: for each query text the documents with the highest scores, over a two-level quantised index.

Queries come in blocks of a bounded size. For a block, the second level of the index holds of every document its length and the exact
frequencies of the block's terms; the first level holds, instead of frequencies, impacts of one byte, rounded up. From bytes alone a
search bounds every score from above and below: a task keeps each query's k highest lower bounds as it reads, and lets a document go
only if its upper bound is below the k-th of them. The k-th highest lower bound over all tasks then decides, and every document
whose upper bound reaches it is scored exactly, in integers, from the second level. No bound is missed, so the result is that of scoring all documents.

Cases: a null text has no term; documents and queries without a term have no row. Documents that no term of a query occurs in, or that score 0, have no row
for it. Repeated rows are documents of their own, and rows of a query key are queries of their own. Equal scores go to the smaller key
(null last), then to the row read first. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.llm.common import map_batches, materialize, small_batches, texts_of
from chronoweft.llm.terms import portions, terms

TOP = 10
#: An impact is at most 1,000,000; a byte stands for so much of it.
STEP = 4096
#: Queries of a block, and their different terms together, about.
BLOCK_QUERIES = 1024
BLOCK_TERMS = 1 << 17
#: Candidates may be broadcast up to so many rows (of two numbers); more are joined by shuffle.
BROADCAST_ROWS = 1 << 18


def impact(tf, n, documents: int, length: int):
    """Of a term with frequency tf in a document of n terms, in a corpus of `documents` with `length` terms; in whole numbers, for arrays."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * n * documents // length))


def term_weight(documents: int, with_term: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * with_term + 1)))


@dataclass
class Block:
    """Queries and the numbers of their terms: query i holds terms[i] counts[i] times."""

    queries: list[int]
    terms: list[np.ndarray]
    counts: list[np.ndarray]
    vocabulary: dict[bytes, int]


def blocks_of(queries: DataFrame, text: str) -> tuple[DataFrame, Iterator[Block]]:
    """(queries with a row number, the blocks); one block at a time is on the driver."""
    numbered = materialize(queries.withColumn("__query", F.monotonically_increasing_id()), "queries")
    sizes = numbered.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("bytes")).first()
    parts = max(1, -(-sizes["n"] // BLOCK_QUERIES), -(-(sizes["bytes"] or 0) // (BLOCK_TERMS * 8)))

    def each() -> Iterator[Block]:
        for part in range(parts):
            own = numbered.filter(F.pmod(F.xxhash64("__query"), F.lit(parts)) == part).select("__query", text).orderBy("__query").collect()
            vocabulary: dict[bytes, int] = {}
            block = Block([], [], [], vocabulary)
            for number, t in own:
                found = Counter(terms(t or ""))
                if found:
                    block.queries.append(number)
                    block.terms.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in found], np.int64))
                    block.counts.append(np.array(list(found.values()), np.int64))
            if block.queries:
                yield block

    return numbered, each()


def second_level(docs: DataFrame, vocabulary: dict[bytes, int], text: str, key: str) -> DataFrame:
    """row, id, n (all terms of the whole text), and terms and tf of those that the vocabulary has."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("__text"))

    def lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))

    def make():
        known = shared.value
        size = max(len(known), 1)

        def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            split = [terms(t) for t in texts]
            n = np.fromiter(map(len, split), np.int64, len(split))
            ids = np.fromiter(map(known.get, chain.from_iterable(split), repeat(-1)), np.int64, int(n.sum()))
            at = np.flatnonzero(ids >= 0)
            posting, tf = np.unique(np.repeat(np.arange(len(texts)), n)[at] * size + ids[at], return_counts=True)
            return n, posting % size, tf, np.bincount(posting // size, minlength=len(texts))

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch, "__text")
            got = [counted(texts[s:e]) for s, e in portions(texts)]
            n, found, tf, sizes = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in range(4))
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), lists(found.astype(np.int32), sizes), lists(tf.astype(np.int64), sizes)], ["id", "n", "terms", "tf"])

        return one

    found = map_batches(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, n long, terms array<int>, tf array<long>", rows=256, operator="lexical_search")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "search-exact")


def first_level(exact: DataFrame, documents: int, length: int) -> DataFrame:
    """row, terms and impacts of one byte each, rounded up; rows without a term are left out."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, tf = batch.column("terms"), batch.column("tf").flatten().to_numpy()
            sizes = found.value_lengths().to_numpy()
            n = np.repeat(batch.column("n").to_numpy(), sizes)
            up = -(-impact(tf, n, documents, length) // STEP)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([batch.column("row"), found, pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(up.astype(np.uint8))])], ["row", "terms", "impacts"])

        return one

    held = exact.filter(F.size("terms") > 0).select("row", "n", "terms", "tf")
    return materialize(map_batches(held, make, "row long, terms array<int>, impacts binary", rows=2048, operator="lexical_search"), "search-bytes")


class Bounds:
    """Upper and lower bounds of all queries of a block for batches of documents, and the highest lower bounds seen so far."""

    def __init__(self, block: Block, weights: np.ndarray, top: int) -> None:
        self.n, self.top = len(block.queries), top
        of = np.concatenate(block.terms)
        query = np.repeat(np.arange(self.n), [len(t) for t in block.terms])
        gain = (np.concatenate(block.counts) * weights[of]).astype(np.float64)  # sums stay far below 2^53
        spread = np.bincount(of, minlength=len(weights))
        #: Terms of many queries are multiplied as a dense matrix, the others posting by posting.
        common = np.flatnonzero(spread * 16 >= self.n)
        self.place = np.full(len(weights), -1)
        self.place[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n))
        dense = self.place[of] >= 0
        self.dense[self.place[of[dense]], query[dense]] = gain[dense]
        order = np.argsort(of, kind="stable")
        self.query, self.gain = query[order], gain[order]
        self.start = np.concatenate([[0], np.cumsum(spread)])
        self.best = np.zeros((top, self.n))

    def _sums(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """For each document and query, the sum of gain times value over the common terms."""
        often = self.place[term] >= 0
        wide = np.zeros((docs, len(self.dense)))
        wide[doc[often], self.place[term[often]]] = value[often]
        total = wide @ self.dense
        doc, term, value = doc[~often], term[~often], value[~often]
        many = self.start[term + 1] - self.start[term]
        at = np.repeat(self.start[term] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        total += np.bincount(np.repeat(doc, many) * self.n + self.query[at], self.gain[at] * np.repeat(value, many), docs * self.n).reshape(docs, self.n)
        return total

    def candidates(self, doc: np.ndarray, term: np.ndarray, byte: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, query, upper bound, lower bound) of the pairs that may still be among the first."""
        some = byte > 0
        doc, term, byte = doc[some], term[some], byte[some].astype(np.float64)
        held = self._sums(doc, term, byte, docs)
        upper, lower = STEP * held, STEP * held - (STEP - 1) * self._sums(doc, term, np.ones(len(byte)), docs)
        self.best = -np.partition(-np.vstack([self.best, lower]), self.top - 1, axis=0)[: self.top]
        at, query = np.nonzero((upper >= self.best.min(0)) & (upper > 0))
        return at, query, upper[at, query], lower[at, query]


def bounded(bytes_level: DataFrame, block: Block, weights: np.ndarray, top: int) -> DataFrame:
    """query, row, upper, lower of the pairs that a task can't rule out by its own documents."""
    spark = bytes_level.sparkSession
    shared = spark.sparkContext.broadcast((block, weights))
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = shared.value
        bounds, numbers = Bounds(own, weight, top), np.array(own.queries, np.int64)
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                b = whole.slice(s, 1024)
                found = b.column("terms")
                sizes = found.value_lengths().to_numpy()
                byte = np.frombuffer(b"".join(b.column("impacts").to_pylist()), np.uint8)
                at, query, upper, lower = bounds.candidates(np.repeat(np.arange(b.num_rows), sizes), found.flatten().to_numpy(), byte, b.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[query]), b.column("row").take(pa.array(at)), pa.array(upper), pa.array(lower)], ["query", "row", "upper", "lower"])

    found = materialize(bytes_level.mapInArrow(run, "query long, row long, upper double, lower double"), "search-bounds")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lower")))
    last = found.withColumn("place", place).filter(F.col("place") <= top).groupBy("query").agg(F.when(F.count("*") == top, F.min("lower")).otherwise(F.lit(0.0)).alias("least"))
    return materialize(found.join(F.broadcast(last), "query").filter(F.col("upper") >= F.col("least")).select("query", "row"), "search-candidates")  # last: a row for each query of the block


def exact_scores(candidates: DataFrame, exact: DataFrame, block: Block, weights: np.ndarray, documents: int, length: int) -> DataFrame:
    """query, row, id, score: whole numbers only."""
    spark = exact.sparkSession
    few = candidates.count() <= BROADCAST_ROWS
    gains = [(q, int(t), int(c * weights[t])) for q, ts, cs in zip(block.queries, block.terms, block.counts, strict=True) for t, c in zip(ts, cs, strict=True)]
    gains = F.broadcast(spark.createDataFrame(gains, "query long, term int, gain long"))  # bounded with the block
    wanted = candidates.select("row").distinct()
    needed = exact.join(F.broadcast(wanted) if few else wanted, "row", "semi")
    pairs = needed.join(F.broadcast(candidates) if few else candidates, "row").select("query", "row", "id", "n", F.inline(F.arrays_zip("terms", "tf")))
    pairs = pairs.withColumnRenamed("terms", "term").join(gains, ["query", "term"])
    m = F.expr(f"100 - 75 + (75 * n * {documents}L) div {length}L")
    part = (F.col("gain") * F.expr("(1000000000L * tf) div (1000 * tf + 8 * m)")).alias("part")
    return pairs.withColumn("m", m).select("query", "row", "id", part).groupBy("query", "row", "id").agg(F.sum("part").alias("score"))


def search(docs: DataFrame, queries: DataFrame, text: str = "text", key: str = "doc_id", query_text: str = "text", query_key: str = "item_id", top: int = TOP) -> DataFrame:
    """query_key, rank, key and score of the first `top` documents of each row of queries."""
    spark = docs.sparkSession
    numbered, blocks = blocks_of(queries.select(F.col(query_key).alias("__query_key"), F.col(query_text).alias("__query_text")), "__query_text")
    found = []
    for block in blocks:
        exact = second_level(docs, block.vocabulary, text, key)
        documents, length = exact.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            break
        with_term = np.zeros(len(block.vocabulary), np.int64)
        for t, n in exact.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            with_term[t] = n
        weights = np.array([term_weight(documents, int(n)) for n in with_term], np.int64)
        candidates = bounded(first_level(exact, documents, length), block, weights, top)
        found.append(exact_scores(candidates, exact, block, weights, documents, length).filter("score > 0"))
    if not found:
        return _result(spark.createDataFrame([], f"query long, row long, id {docs.schema[key].dataType.simpleString()}, score long"), numbered, query_key, key, top)
    return _result(reduce(DataFrame.unionByName, found), numbered, query_key, key, top)


def _result(scored: DataFrame, numbered: DataFrame, query_key: str, key: str, top: int) -> DataFrame:
    order: list[Column] = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    first = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= top)
    named = first.join(numbered.select(F.col("__query").alias("query"), "__query_key"), "query")
    return named.select(F.col("__query_key").alias(query_key), "rank", F.col("id").alias(key), "score")
