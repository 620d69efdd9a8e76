"""Pairs of signatures by every plan of bands; short targets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chronoweft.operators import similarity


@pytest.mark.parametrize(("most", "plan"), [(3, None), (9, None), (17, (6, 2)), (17, (18, 0)), (24, (8, 3)), (5, (2, 2)), (0, None)])
def test_signature_pairs_like_all_pairs(spark, most, plan):
    rng = random.Random(most)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = [rng.getrandbits(64) for _ in range(60)] + [v ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(most + 3))) for v in base for _ in range(6)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, signature long")
    got = {tuple(r) for r in similarity.signature_pairs(df, most, plan=plan).collect()}
    expected = {(i, j, (values[i] ^ values[j]).bit_count()) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= most}
    assert got == expected and similarity.signature_pairs(df, most, plan=plan).count() == len(expected)


def test_band_plans():
    """Many rows are worth probes; few differing bits need none."""
    assert similarity.band_plan(0, 10**6) == (1, 0)
    bands, bits = similarity.band_plan(12, 10**6)
    assert bits >= 1 and 12 // bands == bits
    for most in (3, 7, 12, 17, 24):
        bands, bits = similarity.band_plan(most, 10**5)
        assert most // bands <= bits


def test_short_targets_without_a_bound(spark):
    """More targets of one and two words than any list in the plan would take, within longer words too."""
    targets = [(k, f"w{k}") for k in range(1200)] + [(5000, "a"), (5001, "two words"), (5002, "日"), (5003, "")]
    texts = [(1, "xw17y, w1199. two wordsmiths"), (2, "日本"), (3, None), (4, "b"), (5, "w17")]
    got = similarity.exact_matches(spark.createDataFrame(targets, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string").withColumn("n", F.lit("clash")), 4)
    expected = {(i, d, t.index(w) + 1) for i, w in targets if w for d, t in texts if t and w in t}
    assert {tuple(r) for r in got.collect()} == expected
