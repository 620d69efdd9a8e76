"""Selections written as text, joined tokens, percentiles and other small column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def expanded_ranges(text: Column) -> Column:
    """Numbers of a selection such as `1-3,7,9-8` in the order written; a descending range counts down. Parts that are no numbers are left out."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda p: p.rlike(r"^\d+(\s*-\s*\d+)?$"))
    ends = lambda p: F.split(p, r"\s*-\s*")
    first, last = (lambda p: F.element_at(ends(p), 1).cast("int")), (lambda p: F.element_at(ends(p), -1).cast("int"))
    return F.flatten(F.transform(parts, lambda p: F.sequence(first(p), last(p))))


def selection(text: Column) -> Column:
    """The distinct numbers of a selection, ascending; null where a range descends."""
    falls = F.exists(F.split(text, ","), lambda p: F.regexp_extract(p, r"^\s*(\d+)\s*-\s*(\d+)\s*$", 1).try_cast("int") > F.regexp_extract(p, r"^\s*(\d+)\s*-\s*(\d+)\s*$", 2).try_cast("int"))
    return F.when(~F.coalesce(falls, F.lit(False)), F.array_sort(F.array_distinct(expanded_ranges(text))))


def joined_tokens(tokens: Column) -> Column:
    """Tokens as text: no space before closing marks, after opening ones, or next to a CJK character."""
    clean = F.filter(F.transform(tokens, lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != "")
    tight = lambda acc, t: t.rlike(r"^[,.!?;:%)\]}，。！？；：、）》】]") | acc.rlike(r"[(\[{（《【]$") | acc.rlike("[\\u3400-\\u9fff]$") | t.rlike("^[\\u3400-\\u9fff]")
    return F.aggregate(clean, F.lit(""), lambda acc, t: F.when(acc == "", t).when(tight(acc, t), F.concat(acc, t)).otherwise(F.concat(acc, F.lit(" "), t)))


def rank_percentile(values: Column, share: float) -> Column:
    """Nearest rank of an array: element ceil(n * share), 0 for none."""
    ordered, n = F.array_sort(values), F.size(values)
    return F.coalesce(F.try_element_at(ordered, F.greatest(F.lit(1), F.least(n, F.ceil(n * share))).cast("int")), F.lit(0.0))


def rounded_percentile(values: Column, share: float) -> Column:
    """The element of an array at round((n - 1) * share), half to even; 0 for none."""
    ordered, n = F.array_sort(values), F.size(values)
    return F.coalesce(F.try_element_at(ordered, (F.bround((F.greatest(n, F.lit(1)) - 1) * share) + 1).cast("int")), F.lit(0.0))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c) for c in columns])


def finite(value: Column) -> Column:
    """A number, or null where it is not finite."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def reconciled_range(start: Column, end: Column, duration: Column) -> Column:
    """Struct (start, end) from any two of start, end and duration; null where that isn't enough or end is before start."""
    s = F.coalesce(start, end - duration)
    e = F.coalesce(end, start + duration)
    return F.when((s >= 0) & (e >= s), F.struct(s.alias("start"), e.alias("end")))


def seconds_of_range(value: Column) -> Column:
    """Values over 10,000 are microseconds."""
    return F.when(value > 10_000, value / 1_000_000).otherwise(value)


def keyword_route(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first route one of whose words occurs in the text, in any case."""
    out = F.lit(default)
    for route, words in reversed(list(rules)):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(text), F.lit(w.lower()))
        out = F.when(hit, route).otherwise(out)
    return out


def host_provider(url: Column, providers: Sequence[str], default: str = "unknown") -> Column:
    """The first provider whose name is part of a URL."""
    return keyword_route(F.coalesce(url, F.lit("")), [(p, [p]) for p in providers], default)
