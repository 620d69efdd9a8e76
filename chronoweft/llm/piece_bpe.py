"""SentencePiece encoding and decoding with a merge-type prefix table.

A merge-type (BPE) encoding is the one sequence of pieces in which every two neighbours are compatible, that is,
in which the merges would cut the two pieces' joint text at the same place. So each prefix of a text has one last
piece, and a table of these last pieces is enough: an Aho-Corasick automaton gives all pieces that end at a
position, and the one that is compatible with the last piece of the prefix before it is stored. Ids are then
recovered backwards from the end. Texts are cut at places that no piece spans (before white space, around line
breaks), and the results of recent cuts are kept in a bounded cache.

The model file is read on the driver and sent to the executors. Models with another normalisation than the
identity are refused.

Cases: a null or empty text has the end id only and decodes to an empty text. Characters that no piece has become
byte pieces. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import held_by, map_batches, texts_of

SPACE = "▁"
_UNKNOWN = -1
_CACHE_CHUNKS = 400_000
#: Longer chunks aren't kept, which gives the cache a bound in bytes.
_CACHE_CHUNK_CHARS = 48
_CACHE_PAIRS = 1_000_000


@dataclass
class PieceTable:
    """What a model file says, without the library."""

    pieces: dict[str, int]
    scores: list[float]
    byte_ids: list[int]
    end_id: int
    whole: set[int] = field(default_factory=set)  # pieces that their own merges lead to
    inner: set[str] = field(default_factory=set)  # pairs of characters that stand side by side in a piece

    def merge(self, text: str) -> list[str]:
        """Plain merging by score, leftmost first: the rule that compatibility refers to. For short texts only."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.pieces.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


def read_model(path: str) -> PieceTable:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm, kinds = proto.normalizer_spec, proto.SentencePiece
    if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not proto.trainer_spec.byte_fallback:
        raise NotImplementedError("only identity normalisation with a space in front and byte fallback")
    if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) or SPACE in p.piece.lstrip(SPACE) for p in proto.pieces if p.type != kinds.BYTE):
        raise NotImplementedError("pieces that are user-defined, unused or span a space")
    normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
    byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
    table = PieceTable(normal, [p.score for p in proto.pieces], [byte_ids[b] for b in range(256)], sentencepiece.SentencePieceProcessor(model_file=path).eos_id())
    table.whole = {i for p, i in normal.items() if len(p) == 1 or table.merge(p) == [p]}
    table.inner = {p[k : k + 2] for p in normal for k in range(len(p) - 1)}
    return table


class PieceCoder:
    """Encodes and decodes; holds the automaton and the caches of one process."""

    def __init__(self, table: PieceTable) -> None:
        self.table = table
        self.text = {i: p for p, i in table.pieces.items()}
        self.byte = {i: b for b, i in enumerate(table.byte_ids)}
        self.automaton = ahocorasick.Automaton()
        for piece, i in table.pieces.items():
            if i in table.whole:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        breaks = "".join(c for c in "\n\t\r" if not any(c in p for p in table.pieces))
        self.cut = re.compile(f" *[^ {breaks}]+| +|[{breaks}]" if breaks else " *[^ ]+| +")
        self.compatible: dict[int, bool] = {}
        self.chunks: dict[str, tuple[int, str, str]] = {}

    def _fits(self, left: int, right: int) -> bool:
        a, b = self.text[left], self.text[right]
        ok = a[-1] + b[0] not in self.table.inner or self.table.merge(a + b) == [a, b]
        if len(self.compatible) > _CACHE_PAIRS:
            self.compatible.clear()
        self.compatible[left << 20 | right] = ok
        return ok

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a text with SPACE for white space, by the table of last pieces."""
        n = len(chunk)
        last, length = [_UNKNOWN] * (n + 1), [1] * (n + 1)
        seen = self.compatible
        for end, (piece, size) in self.automaton.iter(chunk):
            if last[end + 1] != _UNKNOWN:  # it is unique
                continue
            start = end + 1 - size
            if start:
                before = last[start]
                if before != _UNKNOWN:
                    ok = seen.get(before << 20 | piece)
                    if not (self._fits(before, piece) if ok is None else ok):
                        continue
            last[end + 1], length[end + 1] = piece, size
        out: list[int] = []
        while n:
            if last[n] == _UNKNOWN:
                out += reversed([self.table.byte_ids[b] for b in chunk[n - 1].encode()])
            else:
                out.append(last[n])
            n -= length[n]
        return out[::-1]

    def decode_chunk(self, ids: list[int]) -> str:
        """Text of ids, spaces restored; runs of byte pieces are UTF-8."""
        out, run = [], bytearray()
        for i in ids:
            b = self.byte.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.text.get(i, ""))  # control pieces have no text
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def _chunks(self, text: str) -> list[tuple[int, str, str]]:
        """(number of ids, ids as text, decoded) of each chunk of a whole text."""
        if not text:
            return []
        known, out = self.chunks, []
        for c in self.cut.findall(" " + text.replace(SPACE, " ")):
            got = known.get(c)
            if got is None:
                ids = self.encode_chunk(c.replace(" ", SPACE))
                got = (len(ids), " ".join(map(str, ids)), self.decode_chunk(ids))
                if len(c) <= _CACHE_CHUNK_CHARS:
                    if len(known) > _CACHE_CHUNKS:
                        known.clear()
                    known[c] = got
            out.append(got)
        return out

    def encode(self, text: str, end: bool = True) -> list[int]:
        return [int(i) for c in self._chunks(text) for i in c[1].split()] + [self.table.end_id] * end

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts in front."""
        text = self.decode_chunk(ids)
        return text[1:] if text.startswith(" ") else text

    def digests(self, text: str) -> tuple[int, str, str]:
        """(number of ids with the end id, SHA-256 of the ids as text, SHA-256 of the decoded ids)."""
        chunks = self._chunks(text)
        ids = " ".join([c[1] for c in chunks] + [str(self.table.end_id)])
        decoded = "".join([c[2] for c in chunks])
        decoded = decoded[1:] if decoded.startswith(" ") else decoded
        return sum([c[0] for c in chunks]) + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest()


def _coder(table: PieceTable) -> PieceCoder:
    """One coder a process and vocabulary, so that its caches outlive a task."""
    key = hash((len(table.pieces), table.end_id, hashlib.sha256("\0".join(table.pieces).encode()).digest()))
    held = held_by("pieces")
    if key not in held:
        held.clear()
        held[key] = PieceCoder(table)
    return held[key]


def encode(df: DataFrame, table: PieceTable, text: str = "text", keep: tuple[str, ...] = ("doc_id",), end: bool = True) -> DataFrame:
    """keep and `ids`, an array of int, of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast(table)
    rows = df.select(*keep, F.col(text).alias("__text"))

    def make():
        coder = _coder(shared.value)
        return lambda b: pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array([coder.encode(t, end) for t in texts_of(b, "__text")], pa.list_(pa.int32()))], [*keep, "ids"])

    return map_batches(rows, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text") + ", ids array<int>", operator="pieces")


def decode(df: DataFrame, table: PieceTable, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and `text`, decoded from an array of ids; null ids give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(table)
    rows = df.select(*keep, F.col(ids).alias("__ids"))

    def make():
        coder = _coder(shared.value)
        return lambda b: pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array([coder.decode(x or []) for x in b.column("__ids").to_pylist()], pa.string())], [*keep, "text"])

    return map_batches(rows, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__ids") + ", text string", operator="pieces")


def digests(df: DataFrame, table: PieceTable, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, number of ids, and the digests of the ids and of the text decoded from them, without moving either."""
    shared = df.sparkSession.sparkContext.broadcast(table)
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))

    def make():
        coder = _coder(shared.value)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            got = [coder.digests(t) for t in texts_of(b, "__text")]
            return pa.RecordBatch.from_arrays([b.column("__key"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

        return one

    return map_batches(rows, make, f"`{key}` {rows.schema['__key'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=128, operator="pieces")
