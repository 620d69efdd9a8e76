"""Clock drift measured in windows, against plain loops and recordings whose drift is known."""

from __future__ import annotations

import math
import random

import pytest

from chronoweft.operators import drift

SCHEMA = "source string, frame long, value double"


def plain_features(values):
    low = sorted(values)[round((len(values) - 1) * 0.2)]
    span = max(values) - low
    energy = [0.0 if span <= 1e-9 else max(0.0, (v - low) / span) for v in values]
    return [0.8 * e + 0.2 * max(0.0, e - p) for e, p in zip(energy, [0.0, *energy])]


def plain_scores(x, y, search, least):
    out = {}
    for lag in range(-search, search + 1):
        pairs = [(x[i], y[i - lag]) for i in range(len(x)) if 0 <= i - lag < len(y)]
        ex, ey = sum(u * u for u, _ in pairs), sum(v * v for _, v in pairs)
        if len(pairs) >= least and ex > 1e-9 and ey > 1e-9:
            share = min(1.0, ex / sum(u * u for u in x), ey / sum(v * v for v in y))
            out[lag] = sum(u * v for u, v in pairs) / math.sqrt(ex * ey) * share
    return out


def recordings(n, late):
    rng = random.Random(7)
    a = [rng.random() ** 3 * 100 for _ in range(n)]
    b = {}
    for f, v in enumerate(a):
        b.setdefault(f - late(f), v)
    return a, {f: v for f, v in b.items() if f >= 0}


def test_scores_equal_plain_loops(spark):
    a, b = recordings(300, lambda f: 4 + f // 90)
    left = spark.createDataFrame([("x", f, v) for f, v in enumerate(a) if f % 41], SCHEMA)  # some frames have no row
    right = spark.createDataFrame([("x", f, v) for f, v in b.items()], SCHEMA)
    cores = drift.probe_cores(left, right, ["source"], 4, 5, 30, 6)
    scores = drift.window_scores(left, right, cores, ["source"], 4, 30, 6)
    got = {(r["probe"], r["lag"]): r["score"] for r in scores.collect()}
    want = {}
    hi = min(300 - 36, max(b) + 1 + 4 - 36)
    for p in range(5):
        core = 10 + (hi - 10) * p // 4
        x = plain_features([a[f] if f % 41 else 0.0 for f in range(core - 6, core + 36)])
        y = plain_features([b.get(f, 0.0) for f in range(core - 10, core + 32)])
        want |= {(p, lag): s for lag, s in plain_scores(x, y, 6, 15).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_measured(spark):
    kinds = {"same": lambda f: 2, "slow": lambda f: 2 + f // 200}
    left, right = [], []
    for k, late in kinds.items():
        a, b = recordings(1500, late)
        left += [(k, f, v) for f, v in enumerate(a)]
        right += [(k, f, v) for f, v in b.items()]
    left += [("short", f, float(f % 5)) for f in range(40)] + [("flat", f, 1.0) for f in range(1500)] + [("alone", 0, 1.0), (None, 0, 1.0)]
    right += [("short", f, float(f % 5)) for f in range(40)] + [("flat", f, 1.0) for f in range(1500)]
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    cores = drift.probe_cores(a, b, ["source"], 2, 8, 100, 12)
    probes = drift.probe_offsets(drift.window_scores(a, b, cores, ["source"], 2, 100, 12), ["source"], 2, 100, 12, 0.6, 0.05)
    got = {r["source"]: r for r in drift.measured(a, probes, ["source"], 0.6, 0.1, 5, 10000, 0.08).collect()}
    assert got["same"]["status"] == "stable" and got["same"]["slope"] == 0 and abs(got["same"]["intercept"] - 0.1) < 1e-9
    assert got["slow"]["status"] == "correction_required" and abs(got["slow"]["slope"] - 1 / 200) < 1e-3
    for k in ("short", "flat", "alone", None):
        assert (got[k]["status"], got[k]["reasons"], got[k]["probes"]) == ("unreliable", "too_few_confident_probes", 0)


def test_boundary_and_bounds(spark):
    scores = spark.createDataFrame([("x", 0, 50, lag, 90, s) for lag, s in ((-3, 0.2), (0, 0.5), (3, 0.9))] + [("x", 1, 60, 0, 90, 0.4), ("x", 2, 70, 1, 90, 0.7), ("x", 2, 70, 2, 90, 0.7)], "source string, probe int, core long, lag int, overlap int, score double")
    got = {r["probe"]: r for r in drift.probe_offsets(scores, ["source"], 0, 10, 3, 0.6, 1.0).collect()}
    assert got[0]["status"] == "search_boundary" and abs(got[0]["margin"] - 0.4) < 1e-9 and got[0]["offset"] == 3 and got[0]["at"] == 55
    assert got[1]["status"] == "low_confidence" and abs(got[1]["margin"] - 1.4) < 1e-9 and abs(got[1]["confidence"] - 0.52) < 1e-9
    assert got[2]["offset"] == 1 and got[2]["margin"] == 0
    with pytest.raises(ValueError):
        drift.probe_cores(scores, scores, ["source"], 0, 4, 10, 3)
