"""Running values over ranges give the rows of the windows over whole timelines, and a hot timeline lies in many ranges."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoweft.operators import greedy, intervals, joins, scans, turns

KEYS = ["source"]


@pytest.fixture(scope="module")
def units(spark):
    """One timeline with most rows, small ones, a null key, ties, repeated and empty intervals, null speakers."""
    rng = random.Random(7)
    rows = []
    for source, n in (("hot", 900), ("b", 40), (None, 30), ("one", 1)):
        at = 0
        for k in range(n):
            at += rng.choice([0, 1, 3, 10, 50])
            rows.append((source, k, at, at + rng.choice([0, 1, 5, 20, 120]), rng.choice(["x", "x", "x", "y", None])))
    return spark.createDataFrame(rows + rows[:3], "source string, id long, start long, end long, speaker string").repartition(5)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda d: Counter(tuple(r) for r in d.select(*sorted(a.columns)).collect())
    assert rows(a) == rows(b)


def test_hot_timeline_lies_in_many_ranges(units):
    laid = scans.cut(units, KEYS, ["start", "end", "id"], 16)
    held = {r[0]: r[1] for r in laid.filter("source = 'hot'").groupBy(scans.PART).count().collect()}
    assert len(held) >= 10 and max(held.values()) < 250
    order = laid.groupBy(scans.PART).agg(F.min(F.struct("source", "start")).alias("a"), F.max(F.struct("source", "start")).alias("b")).orderBy(scans.PART).collect()
    assert all(x.b <= y.a for x, y in zip(order, order[1:], strict=False) if x.b["source"] is not None)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_like_windows(units, parts, monkeypatch):
    if parts == 64:
        monkeypatch.setattr(scans, "BROADCAST_ROWS", 0)
    same(scans.merge(units, KEYS, 4, parts=parts), intervals.merge(units, KEYS, 4))
    same(scans.gaps(units, KEYS, 2, parts=parts), intervals.gaps(units, KEYS, 2))
    same(scans.turns(units, KEYS, 4, parts=parts), turns.turns(units, KEYS, 4))


@pytest.mark.parametrize("forward", [False, True])
def test_as_of_like_window(units, forward):
    left = units.select("source", "id", F.col("start").alias("at"))
    right = units.filter("speaker = 'y'").select("source", F.col("end").alias("at")).distinct()
    same(scans.as_of(left, right, KEYS, tolerance=30, forward=forward, parts=9), joins.as_of(left, right, KEYS, tolerance=30, forward=forward))


def test_running_values(spark, units):
    laid = scans.cut(units, KEYS, ["start", "end", "id"], 11)
    got = scans.running(laid, KEYS, ["start", "end", "id"], low=scans.Running("min", F.col("end")), n=scans.Running("sum", F.lit(1)), who=scans.Running("last", F.col("speaker"), before=True))
    w = scans.Window.partitionBy(*KEYS).orderBy("start", "end", "id")
    frame, before = w.rowsBetween(scans.Window.unboundedPreceding, 0), w.rowsBetween(scans.Window.unboundedPreceding, -1)
    expected = units.withColumn("low", F.min("end").over(frame)).withColumn("n", F.count("*").over(frame)).withColumn("who", F.last("speaker", ignorenulls=True).over(before))
    distinct = units.groupBy("source", "id", "start", "end").count().filter("count = 1").drop("count")  # rows that tie throughout come in any order
    keep = lambda d: d.drop(scans.PART).join(distinct, ["source", "id", "start", "end"])
    same(keep(got), keep(expected))
    none = units.limit(0)
    assert scans.merge(none, KEYS).count() == 0 and scans.turns(none, KEYS, 1).count() == 0


def plain_suppressed(rows, most):
    kept = []
    for r in sorted(rows, key=lambda r: (-r["score"], r.start, r.id)):
        if all(max(0, min(r.end, k.end) - max(r.start, k.start)) <= most * max(min(r.end - r.start, k.end - k.start), 1e-9) for k in kept):
            kept.append(r)
    return kept


def test_choices_by_stretches_like_whole_timelines(units):
    rows = units.filter("source IS NOT NULL").dropDuplicates(["source", "id"]).withColumn("score", (F.col("id") * 37 % 101).cast("long"))
    each = {s: [r for r in rows.collect() if r.source == s] for s in ("hot", "b", "one")}
    assert Counter(map(tuple, greedy.suppressed(rows, KEYS, 0.4).collect())) == Counter(tuple(k) for of in each.values() for k in plain_suppressed(of, 0.4))
    points = rows.withColumn("at", F.col("start")).drop("start", "end")
    got = Counter((r.source, r.id) for r in greedy.emphasis(points, KEYS, 30, 25).collect())
    expected = Counter()
    for s, of in each.items():
        kept = []
        for r in sorted(of, key=lambda r: (-r["score"], r.start, r.id)):
            if len(kept) < 25 and all(abs(r.start - k) >= 30 for k in kept):
                kept.append(r.start)
                expected[s, r.id] += 1
    assert got == expected


def test_tracks_are_numbered_through(spark):
    rows = [("v", k, "cat", float(at), x, 0.0, x + 10, 10.0) for k, (at, x) in enumerate([(0, 0.0), (1, 1.0), (2, 500.0), (100, 0.0), (101, 0.5), (300, 0.0)])]
    df = spark.createDataFrame(rows, "source string, id long, label string, at double, x1 double, y1 double, x2 double, y2 double")
    got = [r.track for r in greedy.tracks(df, KEYS, 2000.0, 40.0, 0.3).orderBy("id").collect()]
    assert got == [1, 1, 2, 3, 3, 4]
