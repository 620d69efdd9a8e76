"""Pairs of similar records: signatures, frames and texts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft.functions.geometry import hamming
from chronoweft.functions.text import all_ngrams, bound


#: Probes of a row at most, over all bands.
MOST_PROBES = 1024


def band_plan(most: int, rows: int) -> tuple[int, int]:
    """(bands, bits): two signatures that differ in at most `most` of 64 bits differ in at most most // bands of one band's bits; the plan with the least work for so many rows.

    The work is the probes of all rows (each band's value with up to `bits` of its bits flipped) and the pairs that meet by chance.
    """
    best = (float("inf"), most + 1, 0)
    for bands in range(1, most + 2):
        bits, width = most // bands, -(-64 // bands)
        probes = sum(math.comb(width, k) for k in range(bits + 1))
        if bands * probes <= MOST_PROBES or not bits:
            chance = min(1.0, bands * probes / 2**width)
            best = min(best, (rows * bands * probes + rows * rows / 2 * chance, bands, bits))
    return best[1:]


def _flips(width: int, bits: int) -> list[int]:
    """All numbers of `width` bits with at most `bits` ones."""
    return [sum(1 << i for i in c) for k in range(bits + 1) for c in combinations(range(width), k)]


def signature_pairs(rows: DataFrame, most: int, key: str = "id", signature: str = "signature", group: str | None = None, same: Sequence[str] = (), plan: tuple[int, int] | None = None) -> DataFrame:
    """(a, b, distance) for pairs of 64-bit signatures that differ in at most `most` bits and agree in the columns `same`, a < b; pairs of one group are left out.

    The signature is cut into bands, and pairs come from an equality join on bands, where one side probes values near its own (see band_plan). A pair counts only in
    the first band that is near enough, so none comes twice. Up to some 15 bits few rows meet by chance; with more, pairs of random signatures come near to a
    fifth of all (17 bits) or most of them (24 bits), as so many are within that distance of one another's bands.
    """
    bands, bits = plan or band_plan(most, rows.count())
    edges = [64 * k // bands for k in range(bands + 1)]
    band = lambda c, k: F.shiftrightunsigned(c, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)) if bands > 1 else c
    plain = [F.struct(F.lit(k).alias("band"), band(F.col(signature), k).alias("part")) for k in range(bands)]
    columns = lambda p: [F.col(key).alias(p), F.col(signature).alias(f"s{p}"), *([F.col(group).alias(f"g{p}")] if group else []), *same]
    if bits:
        def near(k: int) -> Column:
            return F.transform(F.array(*map(F.lit, _flips(edges[k + 1] - edges[k], bits))), lambda flip: F.struct(F.lit(k).alias("band"), band(F.col(signature), k).bitwiseXOR(flip.cast("long")).alias("part")))

        left = rows.select(*columns("a"), F.inline(F.concat(*map(near, range(bands)))))
    else:
        left = rows.select(*columns("a"), F.inline(F.array(*plain)))
    right = rows.select(*columns("b"), F.inline(F.array(*plain)))
    pairs = left.join(right, [*same, "band", "part"]).filter("a < b").withColumn("distance", hamming(F.col("sa"), F.col("sb"))).filter(F.col("distance") <= most)
    if group:
        pairs = pairs.filter("ga <> gb")
    first = F.lit(None).cast("int")
    for k in reversed(range(bands)):
        first = F.when(F.bit_count(band(F.col("sa"), k).bitwiseXOR(band(F.col("sb"), k))) <= bits, k).otherwise(first)
    return pairs.filter(F.col("band") == first).select("a", "b", "distance")


def frame_distance(hash_a: Column, hash_b: Column, rgb_a: Column, rgb_b: Column) -> Column:
    """The larger of the bits that differ and the distance of mean colours (arrays of three), where black to white is 32; 32 without colours."""
    squares = F.aggregate(F.zip_with(rgb_a, rgb_b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)
    colour = F.when((F.size(rgb_a) >= 3) & (F.size(rgb_b) >= 3), F.bround(F.sqrt(squares) / F.sqrt(F.lit(3 * 255.0**2)) * 32)).otherwise(32)
    return F.greatest(hamming(hash_a, hash_b), colour.cast("int"))


def clip_pairs(samples: DataFrame, most: int, least_matching: int, least_ratio: float = 0.5, key: str = "id") -> DataFrame:
    """(a, b, median, matched, compared) for clips of samples (id, source, duration, fraction, signature, rgb) of other sources and like durations.

    Samples at equal fractions are compared, and a pair stays if enough of them and their median are within `most`, and if the shorter
    clip has at least least_ratio of the longer one's duration. Pairs are found over equal fractions and signature bands.
    """
    near = signature_pairs(samples.select(key, "source", "fraction", "signature"), most, key, group="source", same=("fraction",))
    side = lambda p: samples.select(F.col(key).alias(p), "fraction", *(F.col(c).alias(f"{c}_{p}") for c in ("source", "duration", "signature", "rgb")))
    both = near.select("a", "b").distinct().join(side("a"), "a").join(side("b"), ["b", "fraction"]).filter("source_a <> source_b")
    both = both.filter(F.least("duration_a", "duration_b") >= least_ratio * F.greatest("duration_a", "duration_b"))
    distance = frame_distance(F.col("signature_a"), F.col("signature_b"), F.col("rgb_a"), F.col("rgb_b"))
    each = both.withColumn("d", distance).groupBy("a", "b").agg(F.median("d").alias("median"), F.count_if(F.col("d") <= most).alias("matched"), F.count("*").alias("compared"))
    return each.filter((F.col("matched") >= least_matching) & (F.col("median") <= most))


def _matched(a: str, b: str) -> int:
    """Characters in the blocks of difflib's matcher without its junk heuristic: the longest common block, the first in a and then in b of several, and so on left and right of it.

    A block is found by asking, from each place of a, whether b holds one that is longer than the longest so far. That is a search in C for a place, not a step in Python for each pair of equal characters.
    """
    total, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        size = at = i = 0
        while i + size < len(x):
            if x[i : i + size + 1] in y:
                size, at = size + 1, i
            else:
                i += 1
        if size:
            total += size
            there = y.find(x[at : at + size])
            todo.append((x[:at], y[:there]))
            todo.append((x[at + size :], y[there + size :]))
    return total


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = ((x or "", y or "") for x, y in zip(a, b, strict=True))
    return pd.Series([2.0 * _matched(x, y) / (len(x) + len(y)) if x or y else 1.0 for x, y in pairs], dtype=float)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Matching characters of two texts, twice over their joint length, by longest common blocks without the junk heuristic."""
    return F.pandas_udf(_ratios, "double")(a, b)


def match_score(target: Column, candidate: Column) -> Column:
    """0 to 100: 45 % sequence ratio, 25 % and 15 % of the target and the candidate matched, 10 % bigram Jaccard, 5 % length; 100 for equal texts, 0 for empty ones."""
    from chronoweft.functions.text import character_ngrams, jaccard

    ratio = sequence_ratio(target, candidate)
    matched = ratio * (F.length(target) + F.length(candidate)) / 2
    share = lambda c: F.least(F.lit(1.0), matched / F.length(c))
    fit = F.least(F.length(target), F.length(candidate)) / F.greatest(F.length(target), F.length(candidate))
    weighted = 0.45 * ratio + 0.25 * share(target) + 0.15 * share(candidate) + 0.1 * jaccard(character_ngrams(target), character_ngrams(candidate)) + 0.05 * fit
    return F.when((F.length(target) == 0) | (F.length(candidate) == 0), 0.0).when(target == candidate, 100.0).otherwise(F.bround(100 * weighted, 2))


def repeat_score(a: Column, b: Column) -> Column:
    """Likeness of a text and the one before: the sequence ratio, or the share of the shorter where one contains the other."""
    inside = F.when(F.contains(a, b) | F.contains(b, a), F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))).otherwise(0.0)
    return F.greatest(sequence_ratio(a, b), inside)


#: Short targets are looked for by their first characters, so many at most.
_FIRST_CHARS = 4


def exact_matches(targets: DataFrame, texts: DataFrame, words: int, target: str = "text", text: str = "text", target_key: str = "item_id", text_key: str = "doc_id") -> DataFrame:
    """(target_key, text_key, at) of the texts that contain a target as it is; at is its first place.

    The first and the last word of a target may be parts of longer ones in a text (a quote before, a full stop after), so candidates
    come from an equality join on the words between: on the hash of the first `words` of them, or of all if there are fewer, against
    all runs of as many words of the texts. Targets of fewer than three words have none between: there candidates come from an equality join of their first
    characters with all runs of as many characters of the texts.
    """
    split = lambda c: F.regexp_extract_all(c, F.lit("[^\\s]+"), F.lit(0))
    goals = targets.select(F.col(target_key), F.col(target).alias("__target"), split(F.col(target)).alias("__all")).filter("__target <> ''")
    between = F.slice("__all", F.lit(2), F.least(F.lit(words), F.size("__all") - 2))
    long = goals.filter(F.size("__all") >= 3).select(target_key, "__target", F.size(between).alias("__n"), F.xxhash64(F.array_join(between, " ")).alias("__h"))
    lengths = sorted(r[0] for r in long.select("__n").distinct().collect())  # at most `words` of them
    runs = texts.select(F.col(text_key), split(F.col(text)).alias("__words"))
    empty = F.array().cast("array<struct<__n:int,__h:bigint>>")
    # Distinct hashes of each length: among numbers Spark finds them by a hash set, among structs by comparing all with all.
    hashes = lambda w, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " "))))
    of_length = lambda w, n: F.when(F.size(w) >= n, F.transform(hashes(w, n), lambda h: F.struct(F.lit(n).alias("__n"), h.alias("__h")))).otherwise(empty)
    keyed = runs.select(text_key, F.inline(bound(F.col("__words"), lambda w: F.flatten(F.array(empty, *(of_length(w, n) for n in lengths))))))
    hits = keyed.join(long, ["__n", "__h"]).select(text_key, target_key, "__target").distinct()
    found = hits.join(texts.select(text_key, F.col(text).alias("__text")), text_key)
    short = goals.filter(F.size("__all") < 3).select(target_key, "__target", F.least(F.lit(_FIRST_CHARS), F.length("__target")).alias("__n")).withColumn("__run", F.expr("substring(__target, 1, __n)"))
    starts = sorted(r[0] for r in short.select("__n").distinct().collect())  # at most _FIRST_CHARS of them
    if starts:
        run = lambda n: F.array_distinct(all_ngrams(F.col(text), n))
        parts = texts.select(text_key, F.explode(F.array(*(F.struct(F.lit(n).alias("__n"), run(n).alias("__runs")) for n in starts))).alias("__x")).select(text_key, "__x.__n", F.explode("__x.__runs").alias("__run"))
        asked = parts.join(short, ["__n", "__run"]).select(text_key, target_key, "__target")
        found = found.unionByName(asked.join(texts.select(text_key, F.col(text).alias("__text")), text_key).filter(F.contains("__text", "__target")).select(*found.columns))
    return found.withColumn("at", F.expr("instr(__text, __target)")).filter("at > 0").select(target_key, text_key, "at")


def boundary_overlap(before: Column, after: Column, least: int, most: int) -> Column:
    """The largest length from least to most at which the end of one array equals the start of the next; 0 if none does."""
    fits = lambda k: (F.size(before) >= k) & (F.size(after) >= k) & (F.slice(before, F.size(before) - k + 1, k) == F.slice(after, F.lit(1), k))
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(least), F.lit(most)), lambda k: F.when(F.least(F.size(before), F.size(after)) >= k, fits(k)).otherwise(False))), F.lit(0))


def mean_nearest_distance(a: DataFrame, b: DataFrame, by: Sequence[str], at: str = "at") -> DataFrame:
    """(by, distance): mean over both sides of the distance from each point to the nearest of the other side."""
    from chronoweft.operators.joins import nearest

    one = nearest(a.select(*by, at), b.select(*by, at), by, at, at)
    two = nearest(b.select(*by, at), a.select(*by, at), by, at, at)
    each = one.unionByName(two).filter("nearest IS NOT NULL").withColumn("d", F.abs(F.col(at) - F.col("nearest")))
    return each.groupBy(*by).agg(F.avg("d").alias("distance"))
