"""Alignment of scripts to takes: where a target text was spoken, word by word, over all sources at once.

Three steps: seeds (places where a target and a source share one of the target's rarest runs of words), takes (the best local alignment around
each group of seeds) and one path of takes for each target, in the order of its words. A source is a row with a whole text, e.g. a segment or a document; a place counts its words.

Cases: null or empty texts and texts without a letter or digit have no words, so no take and no row. Targets without a seed have no row. Repeated rows are sources of their own
if their keys differ; rows that share a key count as one source with all their texts' seeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.functions.text import bound

#: Words of a run that a target and a source must share, and how many of a target's runs are looked for: those with fewest places in the sources.
RUN = 3
RAREST = 8
#: Runs that are looked for may be broadcast up to so many (a hash of 8 bytes each); candidates, too.
BROADCAST_ROWS = 1 << 18
MATCH, MISMATCH, GAP = 2, -1, -1
#: Cells of alignments that are worked out together.
CELLS = 1 << 23
#: Percentages from which a target counts as matched, and from which it needs a review.
MATCHED, REVIEW = 82.0, 65.0


def words_of(text: Column) -> Column:
    """Runs of letters and digits of any script, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _runs(words: Column, n: int) -> Column:
    """Hashes of all runs of n words; of all words where there are fewer."""
    def hashes(words: Column) -> Column:
        length = F.least(F.lit(n), F.size(words))
        run = lambda i: F.xxhash64(F.array_join(F.slice(words, i, length), " "))
        return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(1), F.size(words) - length + 1), run)).otherwise(F.array().cast("array<long>"))

    return bound(words, hashes)


def seeds(targets: DataFrame, sources: DataFrame, target_key: str, source_key: str, target: str = "text", source: str = "text", n: int = RUN, rarest: int = RAREST) -> DataFrame:
    """(target_key, source_key, i, j): word i of the target and word j of the source begin a run of n equal words (counted from 0).

    Of each target the `rarest` runs are taken that have fewest places in the sources, but one at least; equal numbers go by hash, then place.
    Targets of fewer words than n have one run of all their words.
    """
    goals = targets.select(F.col(target_key).alias("t"), words_of(F.col(target)).alias("w")).filter("size(w) > 0")
    wanted = goals.select("t", F.size("w").alias("size"), F.posexplode(_runs(F.col("w"), n)).alias("i", "h")).withColumn("n", F.least(F.lit(n), "size"))
    sizes = sorted(r[0] for r in wanted.select("n").distinct().collect())  # at most n of them
    rows = sources.select(F.col(source_key).alias("s"), words_of(F.col(source)).alias("w"))
    places = rows.select("s", F.inline(F.array(*(F.struct(F.lit(k).alias("n"), F.when(F.size("w") >= k, _runs(F.col("w"), k)).alias("hs")) for k in sizes)) if sizes else F.array(F.struct(F.lit(n).alias("n"), F.array().cast("array<long>").alias("hs")))))
    places = places.select("s", "n", F.posexplode("hs").alias("j", "h"))
    asked = wanted.select("n", "h").distinct()
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    places = places.join(F.broadcast(asked) if few else asked, ["n", "h"], "semi")
    often = places.groupBy("n", "h").agg(F.count("*").alias("places"))
    order = Window.partitionBy("t").orderBy("places", "h", "i")
    chosen = wanted.join(often, ["n", "h"]).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= rarest)
    return chosen.select("t", "i", "n", "h").join(places, ["n", "h"]).select(F.col("t").alias(target_key), F.col("s").alias(source_key), "i", "j")


def stretches(found: DataFrame, targets: DataFrame, target_key: str, source_key: str, target: str = "text") -> DataFrame:
    """(target_key, source_key, first, last): seeds of a pair in one stretch of the source, where the next seed is no farther away than the target is long."""
    size = targets.select(F.col(target_key), F.size(words_of(F.col(target))).alias("size"))
    by = Window.partitionBy(target_key, source_key).orderBy("j", "i")
    apart = F.col("j") - F.lag("j").over(by) > F.col("size")
    # Dealt out in a fixed number of portions, as the alignments that follow are long work on few bytes.
    portions = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = found.join(size.groupBy(target_key).agg(F.max("size").alias("size")), target_key).repartition(portions, target_key, source_key).withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
    numbered = numbered.withColumn("stretch", F.sum("new").over(by))
    return numbered.groupBy(target_key, source_key, "stretch").agg(F.min("j").alias("first"), F.max("j").alias("last")).drop("stretch")


def _aligned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A row as of local_alignment for each column of a and of b, words as numbers; what fills up short columns is negative, and another number in a than in b.

    Word by word of a, for all pairs at once. Filled places are below the best score, as they match nothing, and no way back leads through them.
    """
    size, n = a.shape
    many = n > 64
    kind = np.int8 if many and MATCH * size < 1 << 7 else np.int16 if (MATCH + 1) * (size + len(b)) < 1 << 15 else np.int64
    held = np.zeros((size + 1, len(b) + 1, n), kind)
    slope, less = -GAP * np.arange(len(b) + 1)[:, None], np.empty(n, kind)
    for k in range(size):
        row = held[k + 1]
        np.multiply((b == a[k]).view(np.int8), np.int8(MATCH - MISMATCH), out=row[1:])
        row[1:] += held[k, :-1] + kind(MISMATCH)
        np.maximum(row[1:], held[k, 1:] + kind(GAP), out=row[1:])
        np.maximum(row, kind(0), out=row)
        if many:  # a gap within a row, step by step for all pairs, or for few pairs as a running maximum
            for j in range(1, len(b)):
                np.add(row[j], kind(GAP), out=less)
                np.maximum(row[j + 1], less, out=row[j + 1])
        else:
            row[:] = np.maximum.accumulate(row + slope, axis=0) - slope
    every, top = np.arange(n), held.max(axis=0)
    j = top.argmax(axis=0)
    best = top[j, every].astype(np.int64)
    i = held[:, j, every].argmax(axis=0)
    got = np.stack([i, i, j, j, best, np.zeros_like(i)], axis=1)
    live = np.flatnonzero(best)
    while len(live):
        x, y, now = i[live], j[live], held[i[live], j[live], live]
        same = a[x - 1, live] == b[y - 1, live]
        both = now == held[x - 1, y - 1, live] + np.where(same, MATCH, MISMATCH)
        up = ~both & (now == held[x - 1, y, live] + GAP)
        got[live, 5] += both & same
        i[live] = x - (both | up)
        j[live] = y - ~up
        live = live[held[i[live], j[live], live] > 0]
    got[:, 0], got[:, 2] = i, j
    return got


def _portions(a_size: np.ndarray, b_size: np.ndarray) -> Iterator[np.ndarray]:
    """The pairs in portions of like sizes, each of CELLS cells or a single pair."""
    order = np.lexsort((b_size, a_size // 8))
    begin = rows = columns = 0
    for k, (x, y) in enumerate(zip(a_size[order].tolist(), b_size[order].tolist(), strict=True)):
        rows, columns = max(rows, x), max(columns, y)
        if k > begin and (k - begin + 1) * (rows + 1) * (columns + 1) > CELLS:
            yield order[begin:k]
            begin, rows, columns = k, x, y
    if len(order):
        yield order[begin:]


def local_alignments(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """A row as of local_alignment for each pair of lists of words."""
    numbers = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode().indices.to_numpy()
    numbers = numbers.astype(np.int16) if numbers.max(initial=0) < 1 << 15 else numbers
    a_size, b_size = (pc.list_value_length(x).to_numpy().astype(np.int64) for x in (a, b))
    ends = np.cumsum(np.concatenate([a_size, b_size]))
    a_from, b_from = ends[: len(a)] - a_size, ends[len(a) :] - b_size

    def filled(begin: np.ndarray, size: np.ndarray, other: int) -> np.ndarray:
        place = np.arange(size.max())[:, None]
        return np.where(place < size, numbers.take(begin + place, mode="clip"), other)

    got = np.zeros((len(a), 6), np.int64)
    some = np.flatnonzero((a_size > 0) & (b_size > 0))
    for k in _portions(a_size[some], b_size[some]):
        at = some[k]
        got[at] = _aligned(filled(a_from[at], a_size[at], -1), filled(b_from[at], b_size[at], -2))
    return got


def local_alignment(a: list[str], b: list[str]) -> tuple[int, int, int, int, int, int]:
    """(a from, a to, b from, b to, score, equal words) of the best local alignment; of equal scores the one that ends first in b, then in a. All zero if nothing matches."""
    words = pa.list_(pa.string())
    return tuple(int(x) for x in local_alignments(pa.array([a], words), pa.array([b], words))[0])


def takes(targets: DataFrame, sources: DataFrame, target_key: str, source_key: str, target: str = "text", source: str = "text", n: int = RUN, rarest: int = RAREST) -> DataFrame:
    """(target_key, source_key, t_from, t_to, s_from, s_to, score, equal): the best local alignment in each stretch with seeds, within a target's length on both sides."""
    found = stretches(seeds(targets, sources, target_key, source_key, target, source, n, rarest), targets, target_key, source_key, target)
    # Words go to Python as one text, and a target's to the join with the sources as well: that is a third of their array.
    goals = targets.select(F.col(target_key), words_of(F.col(target)).alias("w")).select(target_key, F.size("w").alias("size"), F.array_join("w", " ").alias("goal"))
    rows = sources.select(F.col(source_key), words_of(F.col(source)).alias("words"))
    placed = found.join(goals, target_key).join(rows, source_key)
    begin = F.greatest(F.lit(0), F.col("first") - F.col("size"))
    near = placed.select(target_key, source_key, "goal", begin.alias("begin"), F.array_join(F.slice("words", begin + 1, F.col("last") - begin + n + F.col("size")), " ").alias("near"))
    kinds = {f.name: f.dataType.simpleString() for f in near.schema}

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = local_alignments(pc.split_pattern(b.column("goal"), " "), pc.split_pattern(b.column("near"), " ")).T.copy()
            numbers[2:4] += b.column("begin").to_numpy()
            hit = pa.array(numbers[4] > 0)
            yield pa.RecordBatch.from_arrays([b.column(target_key), b.column(source_key), *map(pa.array, numbers)], [target_key, source_key, "t_from", "t_to", "s_from", "s_to", "score", "equal"]).filter(hit)

    schema = f"`{target_key}` {kinds[target_key]}, `{source_key}` {kinds[source_key]}, t_from long, t_to long, s_from long, s_to long, score long, equal long"
    return near.mapInArrow(align, schema).distinct()


def best_path(spans: list[tuple[int, int, int]]) -> list[int]:
    """Which of the (from, to, score), in order of `to`, make the path of the highest sum.

    On a path each span begins and ends after the one before; words that both have count once, so the sum loses MATCH for each of them. Of equal sums
    the path of fewer spans is taken, then the one whose spans come first.
    """
    n = len(spans)
    begin, end, score = (np.array([s[k] for s in spans], np.int64) for k in range(3))
    sums, long, before = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
    for k in range(n):
        can = np.flatnonzero((begin[:k] < begin[k]) & (end[:k] < end[k]))
        value = sums[can] - MATCH * np.maximum(end[can] - begin[k], 0)
        sums[k], long[k] = score[k], 1
        if len(can) and (top := value.max()) > 0:
            at = can[value == top]
            before[k] = at[np.argmin(long[at])]
            sums[k], long[k] = score[k] + top, long[before[k]] + 1
    path = []
    k = int(np.lexsort((np.arange(n), long, -sums))[0]) if n else -1
    while k >= 0:
        path.append(k)
        k = int(before[k])
    return path[::-1]


def assemble(found: DataFrame, targets: DataFrame, target_key: str, source_key: str, target: str = "text") -> DataFrame:
    """Takes of each target's best path, numbered by place, with the target's coverage (per cent of its words that are equal) and status; `shared` counts the first words of a take that the one before has too.

    Of takes over the same words of a target only the best (then that of the first source and place) can be on a path, so a target has no more takes
    to choose from than ranges of its words, however many sources hold it.
    """
    first = F.min(F.struct((-F.col("score")).alias("score"), F.col(source_key), "s_from", "s_to", "equal")).alias("x")
    reduced = found.groupBy(target_key, "t_from", "t_to").agg(first)
    rows = reduced.select(F.col(target_key).alias("t"), "t_from", "t_to", F.col(f"x.{source_key}").alias("s"), "x.s_from", "x.s_to", (-F.col("x.score")).alias("score"), "x.equal")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows in batches that end with a target."""
        begun: list[pa.RecordBatch] = []
        for b in batches:
            last = np.flatnonzero(b.column("number").to_numpy() == 1)[-1:]
            if len(last):
                yield from pa.Table.from_batches([*begun, b.slice(0, last[0])]).combine_chunks().to_batches()
                begun, b = [], b.slice(last[0])
            begun.append(b)
        if begun:
            yield from pa.Table.from_batches(begun).combine_chunks().to_batches()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole(batches):
            begin, end, score = (b.column(c).to_numpy() for c in ("t_from", "t_to", "score"))
            starts = [*np.flatnonzero(b.column("number").to_numpy() == 1), b.num_rows]
            at, take, shared = [], [], []
            for low, high in zip(starts, starts[1:]):
                path = low + np.array(best_path(list(zip(begin[low:high].tolist(), end[low:high].tolist(), score[low:high].tolist(), strict=True))))
                at.append(path)
                take.append(np.arange(1, len(path) + 1))
                shared.append(np.maximum(np.concatenate([[0], end[path[:-1]]]) - begin[path], 0))
            chosen = b.select(names).take(pa.array(np.concatenate(at)))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(np.concatenate(take)), pa.array(np.concatenate(shared))], [*names, "take", "shared"])

    names = rows.columns
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", take long, shared long"
    chosen = rows.withColumn("number", F.row_number().over(Window.partitionBy("t").orderBy("t_to", "t_from"))).mapInArrow(choose, schema)
    size = targets.groupBy(F.col(target_key).alias("t")).agg(F.max(F.size(words_of(F.col(target)))).alias("size"))
    coverage = F.least(F.lit(100.0), 100.0 * F.sum(F.greatest(F.lit(0), F.col("equal") - F.col("shared"))).over(Window.partitionBy("t")) / F.col("size"))
    judged = chosen.join(size, "t").withColumn("coverage", F.bround(coverage, 2))
    status = F.when(F.col("coverage") >= MATCHED, "matched").when(F.col("coverage") >= REVIEW, "review").otherwise("unmatched")
    return judged.select(F.col("t").alias(target_key), "take", F.col("s").alias(source_key), "t_from", "t_to", "s_from", "s_to", "shared", "score", "equal", "coverage", status.alias("status"))


def target_units(scripts: DataFrame, key: str, text: str = "text", sentences: bool = False) -> DataFrame:
    """(key, index, section, text) of the spoken lines of scripts, from 1: without fenced blocks, headings (which name the section of what follows), list signs and emphasis; or of their sentences."""
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    lines = scripts.select(F.col(key), F.posexplode(F.split(F.col(text), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]")).alias("line", "raw"))
    bare = F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))
    marked = lines.select(key, "line", bare.alias("bare"), F.startswith(bare, F.lit("```")).alias("fence"))
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    spoken = marked.withColumn("inside", F.count_if("fence").over(before) % 2 == 1).withColumn("heading", F.when(~F.col("fence") & ~F.col("inside") & F.startswith("bare", F.lit("#")), clean(F.regexp_replace("bare", "^#+", ""))))
    spoken = spoken.withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(before), F.lit("")))
    spoken = spoken.filter("NOT fence AND NOT inside AND heading IS NULL")
    plain = F.regexp_replace(F.regexp_replace("bare", r"^(?:[-*+]\s+|\d+[.)、]\s*)", ""), r"^\[[ xX]\]\s*", "")
    plain = clean(F.regexp_replace(plain, r"\*\*|__|`", ""))
    parts = F.regexp_extract_all(plain, F.lit(r".+?(?:[。！？!?；;]|\.(?=\s|$)|$)"), F.lit(0)) if sentences else F.array(plain)
    each = spoken.select(key, "line", "section", F.posexplode(parts).alias("part", "one")).withColumn("text", clean(F.col("one"))).filter(F.col("text").rlike(r"[\p{L}\p{N}]"))
    return each.select(key, F.row_number().over(Window.partitionBy(key).orderBy("line", "part")).cast("long").alias("index"), "section", "text")
