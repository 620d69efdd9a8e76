"""Packing: cutting stock by column generation.

Documents are encoded, ended with the end id and cut into full pieces of the capacity and a rest. A linear program
over patterns, i.e. multisets of rest lengths that fit into one sequence, minimises the number of sequences for the
histogram of all rests; its columns come from an unbounded-knapsack dynamic program over the dual prices. Lengths
are counted in classes of UNIT tokens, so the program has a fixed size however many documents there are. The
solution is rounded down, patterns that would leave more than MOST_WASTE empty are given up, and the documents,
ranked within their class, are dealt to the slots of the patterns by arithmetic. Documents that no pattern takes are
laid end to end and cut at the capacity (a cut falls on a multiple of UNIT tokens of a rest).

The ids' checksums of pieces come from prefix checksums that are kept at every multiple of UNIT, so ids are made
once and never moved.

Cases: a null or empty text is one piece, the end id alone. Rows that share an id are packed one by one. An empty
table gives an empty result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.llm.common import held_by, map_batches, materialize

CAPACITY = 2048
UNIT = 8
MOST_WASTE = 0.01
SALTS = 64
#: Sequence ids from here on belong to full pieces.
_FULL = 1 << 44
_CACHE_WORDS, _CACHE_PARTS = 400_000, 200_000


#: Longer words aren't kept, which gives the cache a bound in bytes.
_CACHE_WORD_LENGTH = 64
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Anything but ASCII and Latin-1 letters, and what may be one of the tokenizer's own tokens: such texts need its normalisation.
_NOT_PLAIN = re.compile(rf"[^\t\n\x0b\x0c\r -~{_LETTERS}]|<\|")
#: How the tokenizer cuts a plain text in lower case. A fixed value: the pattern of word_bpe_49k.json, for ASCII and Latin-1.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")


#: ASCII marks that may follow the letters of a word.
_ENDS = "!#$%&*.,:;?|<>)]}\""


class _Remembered(dict):
    """Values of keys as bytes, made when first asked for; begins anew when it holds too many."""

    most = _CACHE_WORDS

    def __missing__(self, key) -> bytes:
        value = self.made(key)
        if len(key) <= _CACHE_WORD_LENGTH:
            if len(self) > self.most:
                self.clear()
            self[key] = value
        return value


class WordIds(_Remembered):
    """Ids of white-space-delimited words as little-endian unsigned 32-bit bytes, from a tokenizer that drops white space."""

    def __init__(self, tokenizer_json: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.parts = _Parts(self.tokenizer.model)
        probe = "It's a straße, Été!? 'tis 12,5 && we'll x--y (z)."
        self.plain = self._plain_ids(probe) == self._ids(probe)

    def made(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        letters = text.rstrip(_ENDS)
        if self.plain and letters.isalpha() and (letters.isascii() or not _NOT_PLAIN.search(letters)):  # letters and then marks: two pieces
            ids = self.parts[letters.lower()]
            return ids + self.parts[text[len(letters) :]] if len(letters) < len(text) else ids
        return self._plain_ids(text) if self.plain and not _NOT_PLAIN.search(text) else self._ids(text)

    def _plain_ids(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, _PIECES.findall(text.lower())))

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.__getitem__, words))


class _Parts(_Remembered):
    """Ids of parts of plain words, by the tokenizer's model alone."""

    most = _CACHE_PARTS

    def __init__(self, model) -> None:
        super().__init__()
        self.model = model
        # The model sees bytes as printable characters: those that aren't printable follow after the first 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def made(self, part: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.alphabet))]).tobytes()


def _word_ids(tokenizer_json: str) -> WordIds:
    held, key = held_by("packing"), zlib.crc32(tokenizer_json.encode())
    if key not in held:
        held.clear()
        held[key] = WordIds(tokenizer_json)
    return held[key]


def lengths_and_checksums(df: DataFrame, tokenizer_json: str, end_id: int, text: str, key: str) -> DataFrame:
    """(id, n, full, rest, grid): number of ids with the end id, checksums of the full pieces, length of the rest and its prefix checksums at every multiple of UNIT and at its end."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], "<u4").tobytes()

    def make():
        words = _word_ids(shared.value)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, full, rest, grid = [], [], [], []
            for text in batch.column("text"):
                ids = words.encode((text.as_py() or "").encode("utf-8", "replace").split()) + end
                count = len(ids) // 4
                cut = count // CAPACITY * CAPACITY * 4
                n.append(count)
                full.append([zlib.crc32(ids[k : k + CAPACITY * 4]) for k in range(0, cut, CAPACITY * 4)])
                rest.append(count % CAPACITY)
                crc, marks = 0, []
                for k in range(cut, len(ids), UNIT * 4):
                    crc = zlib.crc32(ids[k : k + UNIT * 4], crc)
                    marks.append(crc)
                grid.append(np.array(marks, "<u4").tobytes())
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.int32()), pa.array(grid, pa.binary())], ["id", "n", "full", "rest", "grid"])

        return one

    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return map_batches(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, n long, full array<long>, rest int, grid binary", rows=256, operator="packing")


def _priced(value: np.ndarray, weight: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the best total value and how often each item is taken."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = int(np.searchsorted(weight, c, "right"))
        best[c] = best[c - 1]
        if fit:
            got = value[:fit] + best[c - weight[:fit]]
            k = int(got.argmax())
            if got[k] > best[c] + 1e-12:
                best[c], taken[c] = got[k], k
    counts, c = np.zeros(len(weight), np.int64), capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            counts[taken[c]] += 1
            c -= weight[taken[c]]
    return float(best[capacity]), counts


def patterns(weight: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Column generation by the revised simplex method: (patterns as columns, how often each, as reals).

    weight: distinct, ascending; demand: positive.
    """
    m = len(weight)
    columns = np.diag(capacity // weight).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    x = demand / np.diag(columns)
    for step in range(rounds):
        prices = inverse.sum(0)
        value, counts = _priced(np.maximum(prices, 0), weight, capacity)
        if value <= 1 + 1e-7:
            break
        u = inverse @ counts
        rising = u > 1e-9
        if not rising.any():
            break
        ratio = np.full(m, np.inf)
        ratio[rising] = x[rising] / u[rising]
        k = int(ratio.argmin())
        x = x - ratio[k] * u
        x[k] = ratio[k]
        columns[:, k] = counts
        inverse[k] /= u[k]
        u[k] = 0
        inverse -= np.outer(u, inverse[k])
        if step % 1000 == 999:  # against rounding errors
            inverse = np.linalg.inv(columns)
            x = inverse @ demand
        x = np.maximum(x, 0)
    return columns.astype(np.int64), x


@dataclass
class PackingPlan:
    """Which slot a document of a class and rank has. Ranks of a class are dealt to its slots in order, what is left goes to the stream."""

    slot_class: np.ndarray  # ascending; a row for each class of each pattern
    slot_from: np.ndarray  # first rank
    slot_times: np.ndarray  # how many of the class a sequence of the pattern has
    slot_sequence: np.ndarray  # first sequence id of the pattern
    slot_order: np.ndarray  # order within the sequence
    stream_from: np.ndarray  # by class: first rank that goes to the stream
    stream_at: np.ndarray  # by class: where in the stream that document begins, in units
    stream_sequence: int
    ordinal: np.ndarray  # by class: number of documents of smaller classes


def plan(counts: np.ndarray) -> PackingPlan:
    """counts: number of rests by class; class 0 has none."""
    capacity = CAPACITY // UNIT
    weight = np.flatnonzero(counts[1:]) + 1
    slots, dealt, sequence = [], np.zeros(len(counts), np.int64), 0
    if len(weight):
        columns, times = patterns(weight, counts[weight].astype(float), capacity)
        for k in np.argsort(-(weight @ columns), kind="stable"):
            copies = int(times[k] + 1e-6)
            copies = min([copies, *((counts[weight[i]] - dealt[weight[i]]) // columns[i, k] for i in np.flatnonzero(columns[:, k]))])
            if copies < 1 or weight @ columns[:, k] < (1 - MOST_WASTE) * capacity:
                continue
            order = 0
            for i in np.flatnonzero(columns[:, k]):
                slots.append((weight[i], dealt[weight[i]], columns[i, k], sequence, order))
                dealt[weight[i]] += copies * columns[i, k]
                order += columns[i, k]
            sequence += int(copies)
    left = counts - dealt
    left[0] = 0
    at = np.concatenate([[0], np.cumsum(left * np.arange(len(counts)))[:-1]])
    rows = np.array(sorted(slots), np.int64).reshape(-1, 5)
    return PackingPlan(*rows.T, dealt, at, sequence, np.concatenate([[0], np.cumsum(counts)[:-1]]))


def _checksum_between(before: int, whole: int, length: int) -> int:
    """CRC-32 of the last `length` bytes of a text, from that of the text before them and that of the whole."""
    zeros = b"\0" * length
    return whole ^ zlib.crc32(zeros, before) ^ zlib.crc32(zeros)


def pieces_of(ranked: DataFrame, packing: PackingPlan, offsets: np.ndarray) -> DataFrame:
    """The pieces of each document with their sequence and order in it. ranked: id, n, full, grid, class, salt, place."""
    shared = ranked.sparkSession.sparkContext.broadcast((packing, offsets))
    id_type = ranked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, first = shared.value
        for batch in batches:
            kind, salt, place = (batch.column(c).to_numpy() for c in ("class", "salt", "place"))
            rank = first[kind, salt] + place
            source, start, length, crc, seq, order = [], [], [], [], [], []
            for row in range(batch.num_rows):
                q, k, n = int(kind[row]), int(rank[row]), batch.column("n")[row].as_py()
                for c, x in enumerate(batch.column("full")[row].as_py()):
                    source.append(row), start.append(c * CAPACITY), length.append(CAPACITY), crc.append(x)
                    seq.append(_FULL * (c + 1) + int(p.ordinal[q]) + k), order.append(0)
                rest = n % CAPACITY
                if not rest:
                    continue
                grid = np.frombuffer(batch.column("grid")[row].as_py(), "<u4")
                if k < p.stream_from[q]:
                    lo = int(np.searchsorted(p.slot_class, q))
                    hi = int(np.searchsorted(p.slot_class, q, "right"))
                    s = lo + int(np.searchsorted(p.slot_from[lo:hi], k, "right")) - 1
                    copy, nth = divmod(k - int(p.slot_from[s]), int(p.slot_times[s]))
                    cuts = [(0, rest, int(p.slot_sequence[s]) + copy, int(p.slot_order[s]) + nth)]
                else:
                    at, capacity = int(p.stream_at[q]) + (k - int(p.stream_from[q])) * q, CAPACITY // UNIT
                    cuts, done = [], 0
                    while done < q:
                        box, inside = divmod(at + done, capacity)
                        take = min(q - done, capacity - inside)
                        cuts.append((done * UNIT, min(rest, (done + take) * UNIT), p.stream_sequence + box, inside))
                        done += take
                for a, b, s, o in cuts:
                    before = int(grid[a // UNIT - 1]) if a else 0
                    whole = int(grid[-(-b // UNIT) - 1])
                    source.append(row), start.append(n - rest + a), length.append(b - a)
                    crc.append(_checksum_between(before, whole, (b - a) * 4) if a else whole), seq.append(s), order.append(o)
            took = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(took), *(pa.array(x, pa.int64()) for x in (start, length, crc)), batch.column("n").take(took), pa.array(seq, pa.int64()), pa.array(order, pa.int64())], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "order"])

    return ranked.select("id", "n", "full", "grid", "class", "salt", "place").mapInArrow(run, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, order long")


def pack(df: DataFrame, tokenizer_json: str, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    measured = lengths_and_checksums(df, tokenizer_json, end_id, text, key)
    classed = measured.withColumn("class", F.ceil(F.col("rest") / UNIT).cast("int")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    held = materialize(classed, "pack-lengths")
    by_salt = np.zeros((CAPACITY // UNIT + 1, SALTS), np.int64)
    for r in held.groupBy("class", "salt").count().collect():  # a fixed number of classes and salts
        by_salt[r["class"], r["salt"]] = r["count"]
    offsets = np.concatenate([np.zeros((len(by_salt), 1), np.int64), np.cumsum(by_salt, 1)[:, :-1]], 1)
    place = F.row_number().over(Window.partitionBy("class", "salt").orderBy("id", "n", "grid")) - 1
    pieces = pieces_of(held.withColumn("place", place), plan(by_salt.sum(1)), offsets)
    within = Window.partitionBy("sequence_id").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).select(F.col("id").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
