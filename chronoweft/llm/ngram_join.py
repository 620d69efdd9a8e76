"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Finds the classes of documents that are linked, directly or over others, by 100 * |A and B| >= 80 * |A or B| on
their sets of word 5-grams. It is exact; nothing is sampled or capped:

1. A fixed number of counters over all n-gram hashes of all documents tells frequent n-grams from rare ones, which
   gives one total order of n-grams for all documents: rare first, then by hash.
2. Documents with equal sets are one class from the start (digest of the sorted hashes). Of each distinct set the
   prefix under that order is kept, so long that two similar sets share two members of their prefixes.
3. Sets that share such an n-gram form a tile. A first pass over the tiles pairs each set with two others of its tile, and
   in larger tiles sets that are likely to link, so few that they only just hang together. Of these partners a set is compared with the
   few that it meets in most tiles; what is linked is joined, which leaves few classes in a large group of copies.
4. Tiles of more than three sets that still hold several classes are gone through in full, in order of size: a set is compared with those
   of other classes up to 1 / 0.8 times its size. Bitmap signatures (parity of hashed n-grams, as many bits as the
   size band needs) bound the overlap from above. Large tiles are dealt over cells of one size band and two salts, so that no
   task holds a whole tile. A tile only counts for a pair if
   its n-gram comes early enough in both prefixes for their sizes. What passes in two tiles is bounded again by longer bitmaps before it is put to the exact test.
5. The exact test intersects the sorted arrays of hashes, which are only made for what passed the bounds; 40 bits of each
   hash are kept for it. Components come from label propagation in Spark.

Inside, a document is the 64-bit hash of its id and text, so null and repeated ids need no care before the end.

Cases: a null or empty text, or one of white space only, has no n-gram and links with nothing. A text with fewer
than 5 words is one n-gram. Rows that share an id are one document: it links if any of its texts does, and each row keeps
its own n_shingles. A row with a null id links like any other, but is never the smallest id: component_id is null where no row
of its component has an id. Other columns play no part, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.llm.common import WORD_PATTERN, fresh, map_batches, materialize, small_batches

#: Links: SHARE_NUM * |A or B| <= SHARE_DEN * |A and B|.
SHARE_NUM, SHARE_DEN = 80, 100
WIDTH = 5
#: Counters for frequent n-grams: 2 ** COUNTER_BITS, in chunks of 2 ** 16.
COUNTER_BITS = 22
_MOST_FLAG_BITS = 27
#: Bits of a hash that name a tile; sets that meet in one by chance are told apart by the tests.
_TILE_BITS = 40
#: Members of both prefixes that linked sets have in common at least.
SHARED = 2
#: Sets of a tile whose pairs with its first and last set are all pairs.
_STAR_PAIRS = 3
#: Tiles of more sets take part in the first pass with a forest of likely pairs.
_FOREST_SETS = 32
#: How much longer the signatures are that a pair of a large tile must pass before its arrays are compared.
WIDER = 4
#: Sets of a tile that one task compares; larger tiles are dealt over cells.
CELL = 8192
_CACHE_WORDS = 150_000
#: Longer words aren't kept in caches, which so have a bound in bytes.
_CACHE_WORD_BYTES = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= _CACHE_WORD_BYTES:
            if len(self) > _CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


def shingle_hashes(text: str | None, cache: dict | None = None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's 5-word n-grams (of the whole word sequence, if it is shorter)."""
    return np.unique(_all_hashes(text, cache))


def _all_hashes(text: str | None, cache: dict | None = None) -> np.ndarray:
    """The hashes in text order, repeated ones too."""
    if not text:
        return np.zeros(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    cache = _WordHashes() if cache is None else cache
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = max(len(h) - WIDTH + 1, 1)
    mixed = np.full(n, min(len(h), WIDTH), np.uint64)
    for k in range(min(WIDTH, len(h))):
        mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return mixed


def _rarely(order: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Hashes in the total order of all n-grams: those of rare counters first, each part ascending."""
    bucket = (order >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)
    often = frequent[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1
    return np.concatenate([order[often == 0], order[often == 1]])


def prefix_length(n: int) -> int:
    """So many first n-grams, in any total order, that two linked sets that differ share SHARED of them: they have at least four in common."""
    return min(n, n - -(-SHARE_NUM * n // SHARE_DEN) + SHARED)


def early_enough(n: np.ndarray, at: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether an n-gram counts for a pair of sets of n and m members: at places `at` and `other` of their orders, counted from 0.

    Linked sets of these sizes have an overlap of at least 80 / 180 of n + m, so SHARED common members lie within so many first ones of each.
    """
    overlap = -(-SHARE_NUM * (n + m) // (SHARE_NUM + SHARE_DEN))
    return (at < n - overlap + SHARED) & (other < m - overlap + SHARED)


def bitmap_bits(n: int) -> int:
    """Bits of the signature of a set in the size band of n: a power of two, at least n."""
    return max(64, 1 << (n - 1).bit_length()) if n else 64


def bitmap(hashes: np.ndarray, wider: int = 1) -> np.ndarray:
    """Parity signature: how often each bit is hashed to, modulo 2. Halves combine by XOR into the one of half the bits."""
    bits = bitmap_bits(len(hashes)) * wider
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(signature: np.ndarray, size: int) -> np.ndarray:
    while len(signature) > size:
        half = len(signature) // 2
        signature = signature[:half] ^ signature[half:]
    return signature


def may_link(n: int, signature: np.ndarray, sizes: np.ndarray, signatures: np.ndarray) -> np.ndarray:
    """Upper bound: each bit that differs is an n-gram in one set only, so 2 * overlap <= n + m - bits."""
    differ = np.bitwise_count(signatures ^ signature).sum(1, dtype=np.int64)
    overlap = (n + sizes - differ) // 2
    return SHARE_DEN * overlap >= SHARE_NUM * (n + sizes - overlap)


def likeness(n: int, signature: np.ndarray, sizes: np.ndarray, signatures: np.ndarray) -> np.ndarray:
    """Estimated Jaccard index: of 2 sets that differ in d members, a bit of B is odd in (1 - exp(-2 d / B)) / 2 of all cases."""
    bits = 8 * len(signature)
    odd = np.bitwise_count(signatures ^ signature).sum(1, dtype=np.int64) / bits
    apart = -bits / 2 * np.log(np.maximum(1 - 2 * odd, 1e-9))
    return (n + sizes - apart) / (n + sizes + apart)


def packed_array(hashes: np.ndarray) -> bytes:
    """The sorted hashes as _TILE_BITS bits each, big-endian: what is moved for the exact test."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, : _TILE_BITS // 8].tobytes()


def unpacked_array(data: bytes) -> np.ndarray:
    rows = np.zeros((len(data) * 8 // _TILE_BITS, 8), np.uint8)
    rows[:, : _TILE_BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, _TILE_BITS // 8)
    return rows.view(">u8").ravel().astype(np.uint64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on sorted arrays."""
    if SHARE_NUM * max(len(a), len(b)) > SHARE_DEN * min(len(a), len(b)) or not len(a):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return SHARE_DEN * both >= SHARE_NUM * (len(a) + len(b) - both)


def _frequent(docs: DataFrame) -> np.ndarray:
    """One bit for each counter: whether its n-grams occur clearly more often than the mean. Every document counts."""
    chunk = 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cache, held, n = np.zeros(1 << COUNTER_BITS, np.int64), _WordHashes(), [], 0

        def flush() -> None:
            nonlocal n
            if n > 1 << COUNTER_BITS - 4:
                total[:] += np.bincount(np.concatenate(held), minlength=1 << COUNTER_BITS)
            elif n:
                np.add.at(total, np.concatenate(held), 1)
            held.clear()
            n = 0

        for batch in batches:
            for text in batch.column(0):
                held.append((_all_hashes(text.as_py(), cache) >> np.uint64(64 - COUNTER_BITS)).astype(np.int32))
                n += len(held[-1])
                if n > 1 << COUNTER_BITS:
                    flush()
        flush()
        rows = []
        for c in range(len(total) // chunk):
            part = total[c * chunk : (c + 1) * chunk]
            at = np.flatnonzero(part)
            if len(at) > chunk // 3:
                rows.append((c, None, zlib.compress(part.astype(np.uint16 if part.max() < 1 << 16 else np.uint32).tobytes(), 1)))
            elif len(at):
                rows.append((c, at.astype(np.uint16).tobytes(), zlib.compress(part[at].astype(np.uint32).tobytes(), 1)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["chunk", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, at, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                got = sums.setdefault(c, np.zeros(chunk, np.uint64))
                raw = zlib.decompress(n)
                if at is None:
                    got += np.frombuffer(raw, np.uint16 if len(raw) == 2 * chunk else np.uint32)
                else:
                    got[np.frombuffer(at, np.uint16)] += np.frombuffer(raw, np.uint32)
        for c, got in sums.items():
            mean = float(got.mean())
            often = got > mean + 8 * mean**0.5 + 16
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.packbits(often, bitorder="little").tobytes()], pa.binary())], ["chunk", "often"])

    parts = docs.select("text").mapInArrow(count, "chunk int, at binary, n binary").repartition(32, "chunk").mapInArrow(add, "chunk int, often binary")
    out = np.zeros(1 << COUNTER_BITS >> 3, np.uint8)
    for r in parts.collect():  # a fixed size: 2 ** COUNTER_BITS bits
        out[r["chunk"] << 13 : (r["chunk"] + 1) << 13] = np.frombuffer(r["often"], np.uint8)
    return out


def _flags(ids: DataFrame) -> np.ndarray:
    """Bits for a column `id`: which hashes occur; some 16 for each id, 2 ** _MOST_FLAG_BITS (16 MB) at most. Ids that weren't asked for may pass, never the reverse; they cost time, no result."""
    bits = 1 << max(16, min(_MOST_FLAG_BITS, (16 * ids.count()).bit_length()))
    h = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(F.shiftright(h, 5).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(id), {bits}), 32) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    got = words.toPandas()
    out = np.zeros(bits >> 5, np.uint32)
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).astype(np.uint32)
    return out


def _flag_column(flags: np.ndarray):
    return F.pmod(F.xxhash64("id"), F.lit(len(flags) << 5)).alias("flag")


def _flagged(flags: np.ndarray, flag: np.ndarray) -> np.ndarray:
    return (flags[flag >> 5] >> (flag & 31).astype(np.uint32) & 1).astype(bool)


def sets_of(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(key, id, n, digest, signature, prefix) of each row of docs (key, id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def make():
        cache = _WordHashes()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, digest, signature, prefix = [], [], [], []
            for text in batch.column("text"):
                h = shingle_hashes(text.as_py(), cache)
                n.append(len(h))
                signature.append(bitmap(h).tobytes() if len(h) else None)
                digest.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                prefix.append((_rarely(h, shared.value)[: prefix_length(len(h))] >> np.uint64(64 - _TILE_BITS)).astype(np.int64) if len(h) else None)
            made = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(signature, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), *made], ["key", "id", "n", "digest", "signature", "prefix"])

        return one

    return map_batches(docs.select("key", "id", "text"), make, "key long, id long, n long, digest binary, signature binary, prefix array<long>")


def _shared_tiles(entries: DataFrame) -> DataFrame:
    """entries (h, id, n, pos) of the tiles that hold two sets or more: (h, id, pos, size, first, last).

    first and last are the ends of the tile, as partners of each other set in it whose size and places allow a link, else null; the pair of both ends
    comes once. They make up all pairs of a tile of two or three, so sets of such tiles without a partner are left out.
    """

    def tiles(h: np.ndarray, i: np.ndarray, n: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
        sizes = np.diff(np.append(starts, len(h)))
        size = np.repeat(sizes, sizes)
        own = np.arange(len(h))
        partners, kept = [], size > _STAR_PAIRS
        first = np.repeat(starts, sizes)
        for end in (first, np.repeat(starts + sizes - 1, sizes)):
            fits = (own != first) & (i[end] != i[own]) & (SHARE_DEN * np.minimum(n, n[end]) >= SHARE_NUM * np.maximum(n, n[end])) & early_enough(n, pos, n[end], pos[end])
            partners.append((i[end], ~fits))
            kept |= fits
        return pa.RecordBatch.from_arrays([pa.array(h[kept]), pa.array(i[kept]), pa.array(pos[kept]), pa.array(size[kept].astype(np.int64)), *(pa.array(v[kept], mask=m[kept]) for v, m in partners)], ["h", "id", "pos", "size", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []
        held = 0
        for batch in batches:
            rest.append([batch.column(k).to_numpy() for k in range(4)])
            held += batch.num_rows
            if held < 1 << 18:
                continue
            columns = [np.concatenate(x) for x in zip(*rest, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last tile may go on
            if cut:
                yield tiles(*(c[:cut] for c in columns))
            rest, held = [[c[cut:] for c in columns]], 0
        if rest:
            yield tiles(*(np.concatenate(x) for x in zip(*rest, strict=True)))

    return entries.repartition("h").sortWithinPartitions("h", "id").mapInArrow(run, "h long, id long, pos int, size long, first long, last long")


def _made_of(docs: DataFrame, ids: DataFrame, column: str, of: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(id, n, column) of the documents whose id is in ids: of() of the sorted hashes of their n-grams."""
    flags = _flags(ids)
    shared = docs.sparkSession.sparkContext.broadcast(flags)
    marked = docs.select("id", _flag_column(flags), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for batch in batches:
            rows = np.flatnonzero(_flagged(shared.value, batch.column("flag").to_numpy()))
            for part in np.array_split(rows, len(rows) // 256 + 1):
                h = [shingle_hashes(batch.column("text")[int(k)].as_py(), cache) for k in part]
                made = [pa.array([len(x) for x in h], pa.int64()), pa.array([of(x) for x in h], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(part, pa.int64())), *made], ["id", "n", column])

    made = materialize(marked.mapInArrow(run, f"id long, n long, {column} binary"), f"join-{column}")
    return made.join(ids, "id", "left_semi").dropDuplicates(["id"])  # rows that repeat key and text are alike


def _sides(pairs: DataFrame, rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """pairs (a, b) with the columns of rows (id, *columns) of both, named by column and side."""
    of = lambda side: rows.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))
    return pairs.join(of("a"), "a").join(of("b"), "b")


def _near(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps allow to be linked; pairs are distinct."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            keep = []
            for k, (x, y) in enumerate(zip(batch.column("signature_a").to_pylist(), batch.column("signature_b").to_pylist(), strict=True)):
                size = min(len(x), len(y))
                a, b = (folded(np.frombuffer(v, np.uint8), size) for v in (x, y))
                keep.append(bool(may_link(int(na[k]), a, nb[k : k + 1], b[None])[0]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sized = _sides(pairs, signatures, ("n", "signature")).filter(SHARE_DEN * F.least("n_a", "n_b") >= SHARE_NUM * F.greatest("n_a", "n_b"))
    return materialize(sized.mapInArrow(bound, "a long, b long"), "join-near")


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


def _best_partners(pairs: DataFrame, most: int = 3) -> DataFrame:
    """Of pairs (a, b, tiles) those of each document with the ones that it meets in most tiles: at most `most` times as many as documents."""
    both = pairs.select("a", "b", "tiles").union(pairs.select("b", "a", "tiles"))
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("tiles"), "b"))
    best = both.withColumn("nth", nth).filter(F.col("nth") <= most)
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _between_classes(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose ends are of different classes (id, component); an id without a class is one of its own."""
    of = lambda side: classes.select(F.col("id").alias(side), F.col("component").alias(f"class_{side}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).select(*pairs.columns)


def _verified(near: DataFrame, arrays: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, by intersection of the sorted arrays of hashes."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(unpacked_array(x.as_py()), unpacked_array(y.as_py())) for x, y in zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialize(_sides(near, arrays, ("hashes",)).mapInArrow(exact, "a long, b long"), "join-links")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id that occurs in links (a, b); component: the smallest id reachable. Labels spread, and jump to the label of their label, until nothing changes."""
    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "join-both")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "join-labels")
    while True:
        seen = materialize(both.join(labels.select(F.col("id").alias("b"), "component"), "b").select("a", "component"), "join-seen")
        least = seen.groupBy("a").agg(F.min("component").alias("m"))
        spread = labels.join(least.withColumnRenamed("a", "id"), "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("above"))
        new = materialize(spread.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("above", "component")).alias("component")), "join-labels")
        labels = new.select("id", "component")
        if new.filter("old <> component").isEmpty():
            return labels


def _cells(tiles: DataFrame, cell: int) -> DataFrame:
    """tiles (h, sets, id, n, ...) with the cells that each set goes to: (band, i, j, side).

    A tile of up to `cell` sets is one cell. In a larger one each set has a size band, whose linked sets are in the same band or the next
    one, and a salt. Cell (band, i, j) holds as side 1 the sets of that band and salt i, and as side 2 those of salt j of the next band,
    and of this one if i < j. So each pair whose sizes allow a link meets on different sides of one cell, or on side 1 of one with i = j.
    """
    salts = F.ceil(F.col("sets") / cell).cast("int")
    salt, band = F.pmod(F.xxhash64("id"), salts).cast("int"), F.floor(F.log("n") / F.log(F.lit(SHARE_DEN / SHARE_NUM))).cast("int")
    every = F.sequence(F.lit(0), salts - 1)
    at = lambda band, i, j, side: F.struct(band.alias("band"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    left = F.transform(every, lambda t: at(band, salt, t, 1))
    right = F.transform(F.filter(every, lambda t: t < salt), lambda t: at(band, t, salt, 2))
    visits = F.transform(every, lambda t: at(band - 1, t, salt, 2))
    whole = F.array(at(F.lit(-1), F.lit(0), F.lit(0), 1))
    return tiles.select("*", F.inline(F.when(F.col("sets") <= cell, whole).otherwise(F.concat(left, right, visits))))


def _cross_pairs(tiles: DataFrame, cell: int, forest: bool = False) -> DataFrame:
    """(a, b, tiles): pairs of different classes within a tile whose sizes and bitmaps allow a link, and in how many tiles (more rows of a pair add up).

    tiles: h, sets (of the tile), id, n, component, pos, signature. Every tile in full, in order of size. With forest only the likeliest pairs
    that make one class of two, so no more than a tile has sets.
    """
    at = ["h", "band", "i", "j"]
    rows = _cells(tiles, cell).repartition(*at).sortWithinPartitions(*at, "n", "id").select(*at, "side", "id", "n", "component", "pos", "signature")

    def counted(out: list[np.ndarray]) -> pa.RecordBatch:
        got, times = np.unique(np.sort(np.concatenate(out), 1), axis=0, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1]), pa.array(times.astype(np.int64))], ["a", "b", "tiles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, window = None, []  # blocks of the cell that are within reach of the next size
        out: list[np.ndarray] = []
        held = 0
        for batch in batches:
            where = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], 1)
            side, ids, n, kind, pos = (batch.column(k).to_numpy() for k in range(4, 9))
            s = batch.column(9).to_pylist()
            cuts = np.append(np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]).any(1)])), len(ids))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if place != (here := tuple(where[lo].tolist())):
                    place, window = here, []
                for a in range(lo, hi, 128):
                    b = min(a + 128, hi)
                    window = [w for w in window if SHARE_DEN * w.sizes[-1] >= SHARE_NUM * n[a]]
                    block = _Block(ids[a:b], n[a:b], kind[a:b].copy(), pos[a:b], side[a:b], [np.frombuffer(x, np.uint8) for x in s[a:b]])
                    window.append(block)
                    for w in window:
                        pairs = _block_pairs(w, block, here[2] == here[3], window if forest else None)
                        out += pairs
                        held += sum(map(len, pairs))
            if held > 1 << 17:  # a pair's tiles are counted together as far as memory allows
                yield counted(out)
                out, held = [], 0
        if out:
            yield counted(out)

    return rows.mapInArrow(run, "a long, b long, tiles long")


@dataclass
class _Block:
    ids: np.ndarray
    sizes: np.ndarray
    classes: np.ndarray
    places: np.ndarray
    sides: np.ndarray
    signatures: list[np.ndarray]


def _block_pairs(left: _Block, right: _Block, diagonal: bool, merged: list[_Block] | None) -> list[np.ndarray]:
    """Pairs of a set of left and a later one of right that may link; those of one side only on the diagonal, and there of side 1.

    With merged only pairs that are likely to link, the likeliest for each class, whose classes become one in all blocks of merged.
    """
    one = left.classes[0]
    if (left.classes == one).all() and (right.classes == one).all():
        return []
    out = []
    size = min(min(map(len, left.signatures)), min(map(len, right.signatures)))
    low = np.stack([folded(x, size) for x in left.signatures])
    for k in range(len(right.ids)):
        upto = k if left is right else len(left.ids)
        sides = left.sides[:upto] + right.sides[k]
        ok = (left.classes[:upto] != right.classes[k]) & (SHARE_DEN * left.sizes[:upto] >= SHARE_NUM * right.sizes[k]) & ((sides == 3) | diagonal & (sides == 2))
        ok &= early_enough(left.sizes[:upto], left.places[:upto], right.sizes[k], right.places[k])
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        own = folded(right.signatures[k], size)
        if merged is None:
            at = at[may_link(int(right.sizes[k]), own, left.sizes[at], low[at])]
        else:
            likely = likeness(int(right.sizes[k]), own, left.sizes[at], low[at])
            order = np.argsort(-likely, kind="stable")
            at = at[order[likely[order] >= SHARE_NUM / SHARE_DEN - 0.02]]
            at = at[np.unique(left.classes[at], return_index=True)[1]]
            for old in left.classes[at]:
                for block in merged:
                    block.classes[block.classes == old] = right.classes[k]
        if len(at):
            out.append(np.stack([left.ids[at], np.full(len(at), right.ids[k])], 1))
    return out


def _documents(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, id, text): id is a hash of the key and the text; a null text counts as empty."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select("key", F.xxhash64("key", "text").alias("id"), "text")


def _set_classes(docs: DataFrame, sets: DataFrame, cell: int) -> DataFrame:
    """(digest, class) of each distinct set; class is the smallest id of the documents that stand for its sets."""
    one = sets.filter("n > 0").groupBy("digest").agg(F.min(F.struct("id", "row")).alias("r"))
    distinct = materialize(one.select("digest", "r.id", "r.row"), "join-distinct")
    standing = sets.join(distinct.select("row").hint("merge"), "row", "left_semi")
    signatures = standing.select("id", "n", "signature")
    tiles = materialize(_shared_tiles(standing.select("id", "n", F.posexplode("prefix").alias("pos", "h")).select("h", "id", "n", "pos")), "join-tiles")
    stars = [tiles.filter(F.col(p).isNotNull()).select("size", F.least("id", p).alias("a"), F.greatest("id", p).alias("b")) for p in ("first", "last")]
    met = stars[0].unionByName(stars[1])
    often = met.groupBy("a", "b").agg(F.count("*").alias("tiles")).filter(F.col("tiles") >= SHARED)
    groups = tiles.filter(F.col("size") > _FOREST_SETS).select("h", F.col("size").alias("sets"), "id", "pos").join(signatures, "id")
    trees = _cross_pairs(groups.withColumn("component", F.col("id")), cell, forest=True).groupBy("a", "b").agg(F.sum("tiles").alias("tiles"))
    near = _near(_best_partners(often.unionByName(trees).groupBy("a", "b").agg(F.sum("tiles").alias("tiles"))), signatures)
    links = _verified(near, _made_of(docs, _members(near), "hashes", packed_array))
    classes = components(links)
    large = tiles.filter(F.col("size") > _STAR_PAIRS).select("h", "id", "pos").join(classes, "id", "left")
    large = large.select("h", "id", "pos", F.coalesce("component", "id").alias("component"))
    several = large.groupBy("h").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("sets")).filter("least <> most").select("h", "sets")
    small = met.filter(F.col("size") <= _STAR_PAIRS).select("a", "b", F.lit(1).cast("long").alias("tiles"))
    cross = _cross_pairs(large.join(several, "h").join(signatures, "id"), cell).unionByName(_between_classes(small, classes))
    cross = materialize(cross.groupBy("a", "b").agg(F.sum("tiles").alias("tiles")).filter(F.col("tiles") >= SHARED).select("a", "b"), "join-cross")
    near = _near(cross, _made_of(docs, _members(cross), "signature", lambda h: bitmap(h, WIDER).tobytes()))
    classes = components(links.unionByName(_verified(near, _made_of(docs, _members(near), "hashes", packed_array))))
    return distinct.join(classes, "id", "left").select("digest", F.coalesce("component", "id").alias("class"))


def _named(df: DataFrame, text: str, key: str, cell: int) -> DataFrame:
    """(key, id, n, class, component) of every row of df: id as in _documents, component as component_id; class is null for rows without words."""
    small_batches(df.sparkSession)
    docs = _documents(df, text, key)
    sets = materialize(sets_of(docs, _frequent(docs)).withColumn("row", F.monotonically_increasing_id()), "join-sets")
    rows = sets.select("key", "id", "n", "digest").join(_set_classes(docs, sets, cell), "digest", "left")
    rows = materialize(rows.select("key", "id", "n", "class"), "join-classes")
    least = rows.filter("class IS NOT NULL").groupBy("class").agg(F.min("key").alias("least"))
    component = F.when(F.col("class").isNull(), F.col("key")).otherwise(F.col("least")).alias("component")
    rows = materialize(rows.join(least, "class", "left").select("key", "id", "n", "class", component), "join-named")
    # Rows of one key whose texts are of different classes connect these.
    of_key = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("c")).filter("a <> c").select("key", "a")
    again = materialize(rows.join(of_key, "key").filter("component <> a").select("a", F.col("component").alias("b")).distinct(), "join-shared-keys")
    if again.isEmpty():
        return rows
    merged = components(again).select(F.col("id").alias("component"), F.col("component").alias("above"))
    return rows.join(merged, "component", "left").select("key", "id", "n", "class", F.coalesce("above", "component").alias("component"))


def classes_of(df: DataFrame, text: str = "text", key: str = "doc_id", cell: int = CELL) -> DataFrame:
    """(key, n_shingles, component_id) of every row of df; key is an integer."""
    return _named(df, text, key, cell).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one_of_each(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df with one row of each component, that of its smallest key; the same columns.

    Of several rows of that key one with words stays, if any; rows that repeat key and text count as one. Rows with neither
    a key nor words are copies of nothing and all stay.
    """
    rows = _named(df, text, key, CELL).filter("component IS NOT NULL OR n > 0")
    first = F.min(F.struct(F.col("key").isNull().alias("unnamed"), "key", (F.col("n") == 0).alias("empty"), "id"))
    group = F.struct("component", F.when(F.col("component").isNull(), F.col("class")).alias("class"))
    name = fresh(df, "__row")
    kept = rows.groupBy(group.alias("group")).agg(first.alias("r")).select(F.col("r.id").alias(name))
    nothing = F.col(key).isNull() & ~F.coalesce(F.col(text), F.lit("")).rlike(WORD_PATTERN)
    hashed = df.filter(~nothing).withColumn(name, F.xxhash64(F.col(key).cast("long"), F.coalesce(F.col(text), F.lit(""))))
    return hashed.dropDuplicates([name]).join(kept, name, "left_semi").select(*df.columns).unionByName(df.filter(nothing))
