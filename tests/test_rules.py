"""Rules with values worked out by hand from the published behaviour: features, badges, assets, options, review ranges, tags, beats, frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronoweft.functions import geometry
from chronoweft.operators import beats, documents, edits, greedy, inventory, scheduling
from chronoweft.operators.planning import SIGNALS


def test_sync_features(spark):
    """Floor by nearest rank: of 0, 10, 20, 30, 40, 50 the value at round(5 * 0.2) = 1; a flat envelope has none."""
    rows = [("a", k, v) for k, v in enumerate([0.0, 50.0, 10.0, 30.0, 20.0, 40.0])] + [("flat", k, 3.0) for k in range(4)]
    df = spark.createDataFrame(rows, "source string, frame long, value double")
    got = {(r.source, r.frame): round(r.feature, 6) for r in inventory.sync_features(df, ["source"]).collect()}
    assert [got["a", k] for k in range(6)] == [0.0, 1.0, 0.0, 0.5, 0.2, 0.7] and all(got["flat", k] == 0 for k in range(4))


def test_badges(spark):
    """A, B, A within the gap: all three have one; A, A within it: one; an unknown turn between makes the next due."""
    turns = [("x", "A", 0, 1000), ("x", "B", 1000, 2000), ("x", "A", 2000, 2100), ("y", "A", 0, 500), ("y", "A", 1000, 9000), ("y", "unknown", 9000, 9100), ("y", "A", 9100, 9100), ("y", "A", 9200, 9900), ("y", "A", 14000, 15000)]
    df = spark.createDataFrame(turns, "source string, speaker string, start long, end long")
    got = sorted(map(tuple, scheduling.badges(df, ["source"], 2200, 4000).collect()))
    assert got == [("x", "A", 0, 1000), ("x", "A", 2000, 2600), ("x", "B", 1000, 2000), ("y", "A", 0, 600), ("y", "A", 9200, 9900), ("y", "A", 14000, 15000)]


def test_asset_status(spark):
    rows = [
        ("unknown", None, None, None, None, "a.mp4", "warn", "", "license_missing"),
        ("wikimedia", "CC BY 4.0", "https://commons.example/x", None, None, "a.png", "blocked", "attribution_required_but_incomplete", ""),
        ("wikimedia", "CC BY 4.0", "https://commons.example/x", "Ann", None, "a.png", "ready", "", ""),
        ("pexels", None, "https://pexels.example/1", None, None, "a.mp4", "ready", "", ""),
        ("pexels", None, None, None, None, "a.mp4", "warn", "", "source_url_missing,credit_metadata_missing"),
        ("youtube", None, "https://y.example", None, None, "a.mp4", "blocked", "external_asset_needs_usage_clearance", "license_missing"),
        ("owned", "All rights reserved", None, None, None, "https://cdn/a.mp4", "blocked", "license_not_publish_safe", "remote_asset_url_not_local_file"),
    ]
    df = spark.createDataFrame(rows, "p string, l string, u string, c string, t string, path string, status string, issues string, warnings string")
    none = F.lit(None).cast("boolean")
    told = documents.asset_status(F.col("p"), F.col("l"), F.col("u"), F.col("c"), F.col("t"), none, none, F.col("path"), F.lit(True)).alias("s")
    assert df.select("status", "issues", "warnings", told).filter("status <> s.status OR issues <> s.issues OR warnings <> s.warnings").collect() == []
    strict = documents.asset_status(*(F.col(c) for c in "pluct"), none, none, F.col("path"), F.lit(False), known_only=True).alias("s")
    assert df.limit(1).select(strict).first().s.issues == "file_missing,license_missing"


@pytest.mark.parametrize(("primary", "fallback", "candidates", "lacks", "expected"), [(1, 0, 0, 0, 0.5200), (0, 1, 0, 0, 0.5000), (0, 0, 0, 0, 0.4850), (1, 0, 1, 0, 0.5350), (1, 0, 0, 1, 0.4450)])
def test_option_score(spark, primary, fallback, candidates, lacks, expected):
    """All dimensions 0.5, but task fit 0.95 in the first: shifts are clamped one by one."""
    weights = {"task_fit": 0.30, "output_quality": 0.20, "control": 0.15, "reliability": 0.15, "cost_efficiency": 0.10, "latency": 0.05, "continuity": 0.05}
    dims = {n: F.lit(0.5) for n in weights}
    flag = lambda x: F.lit(bool(x))
    got = spark.range(1).select(documents.option_score(dims, weights, flag(primary), flag(fallback), flag(candidates), flag(lacks)).alias("s")).first().s
    shifts = 0.3 * (0.08 if primary else 0 if fallback else -0.05) + 0.05 * (0.08 if fallback and not primary else 0) + 0.15 * (0.08 * candidates - 0.45 * lacks) + 0.05 * (0.06 * candidates - 0.15 * lacks)
    assert got == pytest.approx(0.5 + shifts, abs=1e-4)
    high = spark.range(1).select(documents.option_score(dims | {"task_fit": F.lit(0.95)}, weights, flag(1), flag(0), flag(0), flag(0)).alias("s")).first().s
    assert high == pytest.approx(0.3 * 1.0 + 0.7 * 0.5, abs=1e-4)


def test_review_ranges_and_tags(spark):
    rows = [("f", "silence", "warn", 9000, 9900, 10000), ("f", "black_frames", "fail", 100, 200, 10000), ("f", "loudness", "fail", 0, 1, 10000), ("f", "frozen_video", None, 5000, 6000, 10000)]
    df = spark.createDataFrame(rows, "source string, check string, severity string, start long, end long, length long")
    got = [tuple(r)[1:] for r in documents.review_segments(df, ["source"], 750, 24, "length").orderBy("nth").collect()]
    assert got == [(1, "black_frames", "fail", 0, 950), (2, "frozen_video", None, 4250, 6750), (3, "silence", "warn", 8250, 10000)]
    scenes = spark.createDataFrame([(1,), (2,)], "scene long")
    seen = spark.createDataFrame([(1, "person")], "scene long, category string")
    tracks = spark.createDataFrame([(1, 0.22, 0.1)], "scene long, area double, moved double")
    assert sorted(map(tuple, edits.scene_tags(seen, tracks, scenes, ["scene"]).collect())) == [(1, "dominant_subject", 1), (1, "person", 1), (2, "no_detected_objects", 0)]


def test_repeats_by_truncated_length(spark):
    """8 characters after 7 are longer by 1.15, rounded down: the earlier one goes."""
    rows = [("s", 1, 0, 100, "abcdefg"), ("s", 2, 200, 300, "abcdefgh")]
    df = spark.createDataFrame(rows, "source string, id long, start long, end long, normal string")
    assert [(r.id, r.keep) for r in greedy.adjacent_repeats(df, ["source"], 0.8).collect()] == [(1, 2)]


def test_number_pattern():
    assert SIGNALS["data_specific"][0][0] == r"\d+(\.\d+)?\s*[%倍万kK]?"


def test_beat_cuts():
    half = [500 * k for k in range(40)]
    assert [c[:2] for c in beats.beat_cuts(8000, half)] == [(2000, 4), (4000, 8), (6000, 12)]
    assert beats.beat_cuts(7000, []) == [(3000, None, "max_segment"), (6000, None, "max_segment")]
    cuts = beats.beat_cuts(4200, [0, 1000, 2000, 3000, 4000], 2, 750, 2100)
    assert [c[0] for c in cuts] == [2000, 3000] and cuts[-1][2] == "duration_guard"


def test_beat_plan_of_odd_timelines(spark):
    timelines = spark.createDataFrame([("a", 700), ("b", 7000), (None, 4000), ("c", None), ("d", 0)], "source string, duration long")
    points = spark.createDataFrame([(None, 1000), ("b", None), ("x", 5)], "source string, at long")
    got = [tuple(r)[:5] for r in beats.beat_plan(timelines, points, ["source"]).orderBy("source", "number").collect()]
    assert got == [(None, 1, 0, 1000, "beat"), (None, 2, 1000, 4000, "program_end"), ("a", 1, 0, 700, "program_end"), ("b", 1, 0, 3000, "duration_guard"), ("b", 2, 3000, 6000, "duration_guard"), ("b", 3, 6000, 7000, "program_end")]
    with pytest.raises(ValueError, match="positive"):
        beats.beat_plan(timelines, points, ["source"], 0)


def test_frame_signature_like_loops(spark):
    import random

    rng = random.Random(1)
    frames = [[rng.randrange(256) for _ in range(216)] for _ in range(20)] + [[7] * 216, list(range(216)), [1] * 215, None]
    got = {r.id: r.s for r in spark.createDataFrame(list(enumerate(frames)), "id long, p array<int>").select("id", geometry.frame_signature(F.col("p")).alias("s")).collect()}
    for k, p in enumerate(frames):
        if p is None or len(p) < 216:
            assert got[k] is None
            continue
        grey = [(77 * p[3 * i] + 150 * p[3 * i + 1] + 29 * p[3 * i + 2]) >> 8 for i in range(72)]
        bits = "".join("01"[grey[9 * y + x] > grey[9 * y + x + 1]] for y in range(8) for x in range(8))
        assert got[k].dhash == f"{int(bits, 2):016x}" and got[k].mean_rgb == [round(sum(p[c::3]) / 72, 3) for c in range(3)]
    small = spark.createDataFrame([([5] * (18 * 16 * 3), 18, 16), ([5] * 10, 18, 16), ([5] * 12, 2, 2)], "p array<int>, w int, h int")
    assert [r[0] for r in small.select(geometry.reduced_frame(F.col("p"), F.col("w"), F.col("h"))).collect()] == [[5] * 216, None, None]
