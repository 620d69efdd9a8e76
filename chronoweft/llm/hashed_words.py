"""Hashed words and parts of words, for the classifiers that look words up in fixed numbers of buckets."""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np

BUCKETS = 1 << 15
#: Features of a word: itself, its first 4, 5 and 6 letters, its last 4.
FEATURES = 5
_EDGES = ".,;:!?*%$&#|()[]{}\"'`<>=+-_/\\"
_CACHE_WORDS = 150_000
#: Longer words are looked up by their ends and a digest, which gives the index a bound in bytes.
_LONGEST = 64


def features(word: bytes) -> tuple[int, int, int, int, int]:
    """Buckets of a lower-cased word without edge punctuation; equal for words that only differ there."""
    w = word.decode("utf-8", "replace").lower().strip(_EDGES)
    return tuple(zlib.crc32(part.encode(), seed) % BUCKETS for seed, part in ((1, w), (2, w[:4]), (3, w[:5]), (4, w[:6]), (5, w[-4:])))


def shortened(word: bytes) -> bytes:
    """A word of at most _LONGEST bytes: long ones keep their ends."""
    return word if len(word) <= _LONGEST else word[:24] + b"%08x" % zlib.crc32(word) + word[-24:]


class WordIndex(dict):
    """word -> row number, with the features of each row; begins anew when it holds too many words."""

    def __init__(self, limit: int | None = _CACHE_WORDS) -> None:
        super().__init__()
        self.rows: list[tuple[int, ...]] = []
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(word) > _LONGEST:
            return self[shortened(word)]
        self[word] = at = len(self.rows)
        self.rows.append(features(word))
        return at

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers of all words, number of words of each text)."""
        if self.limit and len(self.rows) > self.limit:
            self.clear()
            self.rows.clear()
        split = [t.encode("utf-8", "replace").split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        return np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum())), sizes


class WordVectors(WordIndex):
    """Also holds a vector of each row: the mean of its features' embeddings."""

    def __init__(self, embeddings: np.ndarray) -> None:
        super().__init__()
        self.embeddings = embeddings
        self.vectors = np.empty((1 << 12, embeddings.shape[1]), np.float32)
        self.filled = 0

    def rows_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(vectors of all words, number of words of each text)."""
        if len(self.rows) > self.limit:
            self.filled = 0
        rows, sizes = self.look_up(texts)
        n = len(self.rows)
        if n > len(self.vectors):
            grown = np.empty((max(n, 2 * len(self.vectors)), self.vectors.shape[1]), np.float32)
            grown[: self.filled] = self.vectors[: self.filled]
            self.vectors = grown
        if n > self.filled:
            self.vectors[self.filled : n] = self.embeddings[np.array(self.rows[self.filled : n])].mean(1)
            self.filled = n
        return self.vectors[rows], sizes
