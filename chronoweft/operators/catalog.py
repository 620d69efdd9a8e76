"""A media catalog: upsert, removal, search, scoring and tiered choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of media by file ending.
MEDIA_KINDS: dict[str, str] = {e: "video" for e in ("mp4", "mov", "mkv", "webm", "avi", "m4v")} | {e: "audio" for e in ("mp3", "wav", "m4a", "aac", "flac", "ogg")} | {e: "image" for e in ("jpg", "jpeg", "png", "webp", "gif", "bmp")}


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], newest: str) -> DataFrame:
    """old and new rows, one a key: the newest; of equally new ones that of new."""
    rows = old.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(newest), F.desc("__side")))).filter("__k = 1").drop("__k", "__side")


def merged_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ledger upsert: each value of new that is not null or empty takes the place of the old one."""
    rest = [c for c in old.columns if c not in keys]
    both = old.alias("o").join(new.alias("n"), list(keys), "full")
    filled = lambda c: F.when(F.col(f"n.{c}").isNotNull() & (F.col(f"n.{c}").cast("string") != ""), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*keys, *(filled(c).alias(c) for c in rest))


def removed(catalog: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return catalog.join(gone, list(keys), "left_anti")


def search(catalog: DataFrame, columns: Sequence[str], text: str, wildcards: bool = True) -> DataFrame:
    """Rows with the text in one of the columns, without regard to case. wildcards: % and _ in the text stand for anything; else columns are read as one text."""
    if wildcards:
        found = F.lit(False)
        for c in columns:
            found = found | F.coalesce(F.lower(F.col(c)).like(f"%{text.lower()}%"), F.lit(False))
        return catalog.filter(found)
    return catalog.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))


def media_kind(path: Column) -> Column:
    """video, audio or image by the ending, other otherwise."""
    kinds = F.create_map(*[F.lit(x) for pair in MEDIA_KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("other"))


def first_class(tokens: Column, rules: Mapping[str, Sequence[str]], default: str) -> Column:
    """The first class of the rules that shares a token."""
    out = F.lit(default)
    for name in reversed(list(rules)):
        out = F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, rules[name]))), name).otherwise(out)
    return out


def recommended(catalog: DataFrame, terms: Sequence[str], name: str, tags: str, length: str, target: float, limit: int, tie: Sequence[str] = ()) -> DataFrame:
    """The `limit` best rows: 3 for a term in the name, 2 for one among the tags, and up to 1 for a length near the target. Ties: nearer length, then name."""
    score = F.lit(0.0)
    for t in terms:
        score = score + F.when(F.contains(F.lower(F.col(name)), F.lit(t)), 3.0).otherwise(0.0) + F.when(F.exists(F.col(tags), lambda x: F.lower(x) == t), 2.0).otherwise(0.0)
    delta = F.abs(F.col(length) - target)
    score = score + F.greatest(F.lit(0.0), 1 - delta / target)
    return catalog.withColumn("score", score).withColumn("delta", delta).filter("score > 0").orderBy(F.desc("score"), "delta", name, *tie).limit(limit)


def best_of_each(rows: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in an order; a total order gives the same row each time."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__k = 1").drop("__k")


def running_budget(rows: DataFrame, by: Sequence[str], order: Sequence[str], cost: str, cap: float) -> DataFrame:
    """rows with what was spent up to and with each, and whether that is within the cap."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(w)).withColumn("within", F.col("spent") <= cap)


def keyed_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[Column], value: str) -> DataFrame:
    """rows with `found`: the value of table (key, value; distinct keys) of the first of several keys that it has. One left join a key, so rows need no number of their own."""
    out = rows
    for k, key in enumerate(keys):
        side = table.select(F.col("key").alias(f"__key{k}"), F.col(value).alias(f"__value{k}"), F.lit(True).alias(f"__hit{k}"))
        out = out.join(side, key == F.col(f"__key{k}"), "left")
    found = F.lit(None)
    for k in reversed(range(len(keys))):
        found = F.when(F.col(f"__hit{k}"), F.col(f"__value{k}")).otherwise(found)
    return out.withColumn("found", found).select(*rows.columns, "found")
