"""Ledgers, gates, receipts and revisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decided(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(default)
    for when, name in reversed(rules):
        out = F.when(when, name).otherwise(out)
    return out


def alias(value: Column, names: Mapping[str, str], default: str = "unknown") -> Column:
    """The canonical name of a value, without regard to case and outer white space."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(value))), F.lit(default))


def gate(artifacts: DataFrame, required: DataFrame, by: Sequence[str], category: str = "category", status: str = "status") -> DataFrame:
    """(by, missing, blocked, warned, status): roll-up of the artifacts of each subject against the categories that it requires (by, category)."""
    each = artifacts.groupBy(*by, category).agg(F.bool_or(F.col(status) == "blocked").alias("b"), F.bool_or(F.col(status) == "review").alias("w"))
    both = required.join(each, [*by, category], "left")
    rolled = both.groupBy(*by).agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("b")).alias("blocked"), F.count_if(F.col("w") & ~F.col("b")).alias("warned"))
    return rolled.withColumn("status", F.when((F.col("missing") > 0) | (F.col("blocked") > 0), "blocked").when(F.col("warned") > 0, "review").otherwise("ready"))


def compared(expected: DataFrame, actual: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, verdict): missing, extra, changed or same for each key on either side; null equals null."""
    both = expected.select(*keys, F.col(value).alias("__e"), F.lit(True).alias("__in_e")).join(actual.select(*keys, F.col(value).alias("__a"), F.lit(True).alias("__in_a")), list(keys), "full")
    verdict = F.when(F.col("__in_a").isNull(), "missing").when(F.col("__in_e").isNull(), "extra").when(~F.col("__e").eqNullSafe(F.col("__a")), "changed").otherwise("same")
    return both.select(*keys, verdict.alias("verdict"))


def repeated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of the keys that come more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are unknown; null keys are."""
    return rows.join(known.select(*keys).distinct(), list(keys), "left_anti")


def set_audit(expected: DataFrame, found: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """(by, missing, unexpected, repeated): how two sets of items of each subject differ."""
    e = expected.select(*by, item).distinct().withColumn("__e", F.lit(1))
    f = found.groupBy(*by, item).agg(F.count("*").alias("__n"))
    both = e.join(f, [*by, item], "full")
    return both.groupBy(*by).agg(F.count_if(F.col("__n").isNull()).alias("missing"), F.count_if(F.col("__e").isNull()).alias("unexpected"), F.count_if(F.col("__n") > 1).alias("repeated"))


def state_at(history: DataFrame, by: Sequence[str], cursor: int | Column, seq: str = "seq", before: str = "before", after: str = "after") -> DataFrame:
    """(by, state): of each artifact the value after its last change up to the cursor, else the value before its first change beyond it."""
    at = F.lit(cursor) if isinstance(cursor, int) else cursor
    return history.groupBy(*by).agg(F.max(F.when(F.col(seq) <= at, F.struct(seq, after))).alias("__last"), F.min(F.when(F.col(seq) > at, F.struct(seq, before))).alias("__next")).select(*by, F.when(F.col("__last").isNotNull(), F.col(f"__last.{after}")).otherwise(F.col(f"__next.{before}")).alias("state"))


def broken_chain(history: DataFrame, by: Sequence[str], seq: str = "seq", before: str = "before", after: str = "after") -> DataFrame:
    """Changes whose number doesn't follow the one before, or that don't begin where it ended."""
    w = Window.partitionBy(*by).orderBy(seq)
    rows = history.withColumn("__n", F.row_number().over(w)).withColumn("__prev", F.lag(after).over(w))
    return rows.filter((F.col(seq) != F.col("__n")) | ((F.col("__n") > 1) & ~F.col(before).eqNullSafe(F.col("__prev")))).drop("__n", "__prev")


def lessons(entries: DataFrame, provider: str, model: str, limit: int) -> DataFrame:
    """Entries (id, provider, model, supersedes, day) for a provider and model, * for any; without those that another match supersedes; exact ones first, then the newest."""
    match = entries.filter(F.col("provider").isin(provider, "*") & F.col("model").isin(model, "*"))
    gone = match.select(F.explode("supersedes").alias("id"))
    left = match.join(gone, "id", "left_anti")
    return left.orderBy(F.desc(F.col("provider") == provider), F.desc(F.col("model") == model), F.desc("day"), "id").limit(limit)


def digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of a canonical JSON: keys sorted, no white space, null fields left out."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def freshness(verified: Column, today: Column, most_days: int) -> Column:
    """stale, future or fresh; unknown without a date."""
    age = F.datediff(today, verified)
    return F.when(age.isNull(), "unknown").when(age < 0, "future").when(age > most_days, "stale").otherwise("fresh")
