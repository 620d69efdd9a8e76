"""What the findings of the third round asked for: results on odd rows, and plans whose work grows with the input."""

from __future__ import annotations

import itertools
import random
import time
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from chronoweft.functions import text as T
from chronoweft.functions import timecode
from chronoweft.functions.text import character_ngrams, fixed, jaccard
from chronoweft.operators import beats, drift, edits, greedy, joins, planning, publishing, revisions, scripts, similarity, transcripts


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_suppression_starts_no_python_for_each_stretch(spark):
    rows = [("a", k, 10 * k, 10 * k + 5, float(k)) for k in range(5)] + [("a", 9, 100, 110, None), ("a", 10, 100, 111, 1.0), ("a", 11, 300, 310, None)]
    df = spark.createDataFrame(rows, "source string, id int, start long, end long, score double")
    got = greedy.suppressed(df, ["source"], 0.5)
    assert "InPandas" not in plan(got)
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 3, 4, 10, 11]


def test_emphasis_starts_no_python_for_each_stretch(spark):
    df = spark.createDataFrame([("a", k, at, float(k)) for k, at in enumerate([0, 4, 8, 100, 200, 205])], "source string, id int, at long, score double")
    got = greedy.emphasis(df, ["source"], 6, 3)
    assert "InPandas" not in plan(got)
    assert sorted(r.id for r in got.collect()) == [2, 3, 5]


def test_timecode_of_a_hundred_hours_and_more(spark):
    seconds = spark.createDataFrame([(360_000.0,), (359_999.0,), (4_000_000.0,)], "s double")
    got = [r[0] for r in seconds.select(timecode.timecode(timecode.seconds_to_frames(F.col("s"), 25), 25)).collect()]
    assert got == ["100:00:00:00", "99:59:59:00", "1111:06:40:00"]


def test_numbers_are_written_as_printf_does(spark):
    values = [1 / 128, 3 / 128, 0.1234565, 0.1234575, 0.0000005, 0.9999995, 0.0, 1.0, -1 / 128] + [k / 2_000_000 for k in range(1, 4001, 2)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[1] for r in df.select("v", fixed(F.col("v"), 6)).collect()] == ["%.6f" % v for v in values]


def test_speakers_of_empty_units_and_of_ties(spark):
    units = spark.createDataFrame([("a", 1, 5, 5), ("a", 2, 20, 20), ("a", 3, 10, 10), ("a", 4, 30, 40), ("a", 5, 100, 100)], "source string, id int, start long, end long")
    spoken = spark.createDataFrame([("a", 0, 10, "x"), ("a", 29, 35, "b"), ("a", 29, 32, "z"), ("a", 36, 39, "z"), ("a", 95, 205, "y"), ("a", 12, 12, "n")], "source string, start long, end long, speaker string")
    got = {r.id: (r.assigned, r.coverage, r.warnings) for r in joins.assign_speakers(units, spoken, ["source"], 10).collect()}
    # Within a row an empty unit is that speaker's; at its edges it is nobody's. Speakers with equal scores and first starts go by name.
    assert got == {1: ("x", 1.0, "mixed"), 2: ("unknown", 0.0, "unlabeled"), 3: ("unknown", 0.0, "unlabeled"), 4: ("b", 1.0, "mixed"), 5: ("y", 1.0, "mixed")}


def test_ngrams_of_a_long_text(spark):
    text = "aé😀" * 20_000 + "b"  # read up to each place again, this would be two thousand million steps
    df = spark.createDataFrame([(text, "x"), ("ab", ""), ("", "ab"), (None, "ab")], "a string, b string")
    got = df.select(F.array_sort(character_ngrams(F.col("a"))).alias("n"), jaccard(character_ngrams(F.col("a")), character_ngrams(F.col("b"))).alias("j")).collect()
    assert [r.n for r in got][:3] == [sorted(["aé", "é😀", "😀a", "😀b"]), ["ab"], []] and [r.j for r in got] == [0.0, 0.0, 0.0, 0.0]


def test_exact_matches_in_a_long_text_compare_no_structs(spark):
    text = " ".join(f"w{k}" for k in range(3000))
    texts = spark.createDataFrame([(1, text), (2, "w1 w2"), (3, None)], "doc_id int, text string")
    targets = spark.createDataFrame([(7, "w5 w6 w7 w8 w9 w10"), (8, "w9 w8 w7 w6 w5 w4"), (9, "1 w2")], "item_id int, text string")
    got = similarity.exact_matches(targets, texts, 4)
    assert "array_distinct(flatten" not in plan(got)
    assert sorted((r.item_id, r.doc_id) for r in got.collect()) == [(7, 1), (9, 1), (9, 2)]


def test_drift_consensus_joins_no_lines_with_probes(spark):
    chance = random.Random(7)
    odd = [("a", 5.0, 0.1), ("a", 5.0, 0.1), ("a", 5.0, 0.13), ("a", 9.0, 0.1), ("a", 9.0, 0.1), ("a", 12.0, 0.3), ("a", 14.0, 0.12), ("b", 1.0, 0.0), ("b", 1.0, 0.0), ("c", 1.0, 0.5)]
    many = [("d", float(t), t * 1e-4 + chance.choice([0.0, 0.01, 0.05, 0.09, 0.3])) for t in sorted(chance.choices(range(2000), k=300))]  # more than are compared with all lines
    df = spark.createDataFrame([(*r, 1.0) for r in odd + many], "source string, at double, offset double, confidence double")
    got = scripts.drift_consensus(df, ["source"], 0.9, 0.08, 5, 500)
    assert "Filter (lat" not in plan(got)
    by = {r.source: r for r in got.collect()}
    for source in "abcd":
        probes = [r[1:] for r in odd + many if r[0] == source]
        at, offset = (np.array(x) for x in zip(*probes, strict=True))
        lines = Counter()
        for (t, y), (u, z) in itertools.product(probes, probes):
            if t < u:
                s = (z - y) / (u - t)
                lines[t, u, s, y - s * t] += 1
        ranked = []
        for (t, u, s, i), copies in lines.items():
            r = np.abs(offset - i - s * at)
            ranked.append((-copies * int((r <= 0.08).sum()), round(float(np.median(r[r <= 0.08])), 9), round(abs(s), 12), t, u, s, i))
        assert by[source].probes == len(probes)
        if ranked:
            s, i = min(ranked)[-2:]
            assert by[source].inliers == int((np.abs(offset - i - s * at) <= 0.08).sum())
            assert abs(by[source].slope - np.polyfit(at[np.abs(offset - i - s * at) <= 0.08], offset[np.abs(offset - i - s * at) <= 0.08], 1)[0]) < 1e-9
        else:
            assert by[source].inliers is None


def test_sequence_ratio_is_that_of_difflib_and_no_step_for_each_pair_of_equal_characters(spark):
    chance = random.Random(3)
    some = lambda letters, most: "".join(chance.choices(letters, k=chance.randrange(most)))
    pairs = [(some("ab", 14), some("abc", 14)) for _ in range(400)] + [(some("aé😀 ", 60), some("aé😀 ", 60)) for _ in range(100)] + [("", ""), ("", "a"), (None, "a"), (None, None)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    got = {r.k: r.ratio for r in df.select("k", similarity.sequence_ratio(F.col("a"), F.col("b")).alias("ratio")).collect()}
    assert got == {k: SequenceMatcher(None, a or "", b or "", autojunk=False).ratio() for k, (a, b) in enumerate(pairs)}
    # Two hundred million pairs of equal characters, which a step in Python each makes minutes.
    began = time.process_time()
    assert similarity._ratios(pd.Series(["a" * 15_000]), pd.Series(["a" * 14_000 + "b"]))[0] == 28_000 / 29_001
    assert time.process_time() - began < 10


def test_sentence_ends_make_the_words_once(spark):
    said = [("a", 10, 20, "one"), ("a", 20, 30, "two."), ("a", 20, 25, "to"), ("a", None, 40, "lost."), ("a", 50, 60, "then"), ("a", 60, 500, "on."), (None, 0, 5, "none."), ("b", 100, 110, "late"), ("b", 105, 108, "early.")]
    words = spark.createDataFrame(said, "source string, start long, end long, text string").withColumn("text", F.lower("text"))
    asked = [("a", 1, 9), ("a", 2, 8), ("a", 3, 19), ("a", 4, 22), ("a", 5, 52), ("a", 6, None), ("b", 7, 60), ("b", 8, 5), (None, 9, 3), ("c", 10, 3)]
    got = transcripts.sentence_ends(words, ["source"], spark.createDataFrame(asked, "source string, id int, at long"), 50, 3)
    assert {r.id: (r["at"], r.moved, r.reason) for r in got.collect()} == {
        1: (9, 33, "extended_to_sentence_end"), 2: (8, 10, "sentence_end"), 3: (19, 33, "sentence_end"), 4: (22, 33, "sentence_end"), 5: (52, 60, "word_end"), 6: (None, None, "unchanged_no_word_nearby"),
        7: (60, 111, "extended_to_sentence_end"), 8: (5, 5, "unchanged_no_word_nearby"), 9: (3, 3, "unchanged_no_word_nearby"), 10: (3, 3, "unchanged_no_word_nearby"),
    }
    assert "lower(" not in plan(got)


def test_revisions_make_documents_and_patches_once(spark):
    made, asked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(total):
        def same(text):
            total.add(1)
            return text

        return F.udf(same, "string")

    documents = spark.createDataFrame([(1, '{"a":1,"b":[2,3]}'), (2, '{"a":5}'), (3, "no json")], "doc int, json string").withColumn("json", counted(made)("json"))
    patches = spark.createDataFrame([(1, 1, "$.a", "1", "7"), (1, 2, "$.b[0]", "2", None), (2, 1, "$.a", "6", "7")], "doc int, number int, path string, before string, after string").withColumn("after", counted(asked)("after"))
    got = {r.doc: (r.json, r.issues) for r in revisions.revised(documents, patches, ["doc"]).collect()}
    assert got == {1: ('{"a":7,"b":[3]}', ""), 2: ('{"a":5}', "stale")}
    assert (made.value, asked.value) == (3, 3)


def test_beat_plan_hands_on_runs_and_not_every_cut(spark):
    cuts = list(beats.beat_runs(10**9, [5, 1000, 900_000, 900_000_000]))
    assert sum(c[2] for c in cuts) > 300_000 and len(cuts) < 30
    # Each cut by itself, as the plan is defined.
    chance = random.Random(5)
    rows = [(k, chance.choice([1, 700, 3000, 3001, 9000, 70_000]), sorted(chance.sample(range(-5, 72_000), chance.choice([0, 1, 5, 40])))) for k in range(60)]
    want = []
    for k, duration, grid in rows:
        grid, at, number = [b for b in grid if 0 < b < duration], 0, 1
        while duration - at > 3000:
            future = [b for b in grid if b > at]
            fit = [b for b in future if 750 <= b - at <= 3000 and duration - b >= 750]
            target = future[min(4, len(future)) - 1] if future else None
            best = min(fit, key=lambda b: (abs(b - target), b)) if fit else None
            end = best if fit else min(at + 3000, duration - 750)
            want.append((k, number, at, end, grid.index(best) + 1 if fit else None, ("beats_per_cut" if best == target else "duration_guard") if fit else "max_segment"))
            at, number = end, number + 1
        want.append((k, number, at, duration, None, None))
    timelines = spark.createDataFrame([r[:2] for r in rows], "source int, duration long")
    points = spark.createDataFrame([(k, b) for k, _, grid in rows for b in grid], "source int, at long")
    got = beats.beat_plan(timelines, points, ["source"])
    assert sorted((r.source, r.number, r.start, r.end, r.beat, r.selected_by) for r in got.collect()) == sorted(want)
    assert "Window" not in plan(got)


def test_rhythm_sorts_each_timeline_once_in_tasks_of_bounded_size(spark):
    cuts = [("a", 0.0004), ("a", 0.0), ("a", 2.0), ("a", 2.00004), ("a", 9.9999), ("a", 10.0), ("a", None), ("b", -1.0), (None, 1.0), ("x", 1.0)]
    boundaries = spark.createDataFrame(cuts * 3, "source string, at double")
    lengths = spark.createDataFrame([("a", 10.0), ("b", 4.0), (None, 2.0), ("n", None)], "source string, duration double")
    got = edits.timeline_rhythm(boundaries, lengths, ["source"], 5)
    assert plan(got).split("== Optimized")[1].split("== Physical")[1].count("+- Sort") <= 2 and "REPARTITION_BY_NUM" in plan(got)
    found = {r.source: (r.cuts, r.shots, r.mean, r.median, r.p90, r.shortest, r.longest, r.final_hold, r.opening, r.middle, r.closing, r.cuts_per_minute) for r in got.collect()}
    # 0.0004 is a cut at 0 after rounding, 9.9999 one at the end; neither leaves a shot.
    assert found == {"a": (3, 2, 5.0, 5.0, 8.0, 2.0, 8.0, 8.0, 2, 0, 1, 18.0), "b": (0, 1, 4.0, 4.0, 4.0, 4.0, 4.0, 4.0, 0, 0, 0, 0.0), None: (0, 1, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 0, 0, 0, 0.0)}


def test_hooks_compile_and_fill_each_slot_once(spark, capfd):
    families = [publishing.HookFamily("n", "{number} facts about {topic}", 0.7, r"\d", 0.06), publishing.HookFamily("v", "vx {persona}", 0.5), publishing.HookFamily("o", "{topic} {other}", 0.5)]
    rows = [(1, "3", "a {persona} b", None, "no"), (2, "4", "t" * 40, "me", "5"), (3, "1", "唯一", "x" * 28, "")]
    df = spark.createDataFrame(rows, "id int, number string, topic string, persona string, text string")
    got = publishing.hook_variants(df, ["id"], families, {n: F.col(n) for n in ("number", "topic", "persona")}, 30)
    # A value is taken as it is, also where it looks like a slot, and one that is missing spoils only hooks that name it.
    assert sorted((r.id, r.number, r.hook, r.status, r.score) for r in got.filter("hook IS NOT NULL").collect()) == [
        (1, 1, "3 facts about a {persona} b", "ready", 0.7), (1, 3, "a {persona} b {other}", "ready", 0.5),
        (2, 1, "4 facts about tttttttttttt", "ready", 0.76), (2, 2, "vx me", "blocked", 0.2), (2, 3, "tttttttttttt {other}", "ready", 0.5),
        (3, 1, "1 facts about 唯一", "blocked", 0.4), (3, 2, "vx xxxxxxxxxxxx", "blocked", 0.2), (3, 3, "唯一 {other}", "blocked", 0.2),
    ]
    assert plan(got).split("== Optimized")[1].split("== Physical")[0].count("RLIKE") <= 8


def test_rules_that_need_a_wide_character_are_told_apart(spark):
    assert all(T.needs_wide(p) for p in ("微信", r"\b(?:抖音|加群)\b", "^薇$|[^a-z]薇", "第[一1](?![0-9百])", "全网贵价?"))
    assert not any(T.needs_wide(p) for p in ("微?a", "(?:微|a)b", "a(微信)?", "[微a]", "微{0}", "(微|a(信|b))", "(?:微)*", r"\bqq号?\b", "微信|vx", "(?<!微)a"))
    rules = {"a": ("微信", "vx"), "b": ("唯一",), "c": ("qq号?",)}
    df = spark.createDataFrame([(1, "VX 微信 qq"), (2, "vx vx é"), (3, "唯一 QQ号"), (4, None), (5, "none")], "id int, text string")
    assert sorted((r.id, r.category, r.matched) for r in T.violations(df, ["id"], "text", rules).collect()) == [(1, "a", "VX"), (1, "a", "微信"), (1, "c", "qq"), (2, "a", "vx"), (2, "a", "vx"), (3, "b", "唯一"), (3, "c", "QQ号")]
    assert [r.s for r in df.orderBy("id").select(T.gate(F.col("text"), rules).alias("s")).collect()] == ["blocked", "blocked", "blocked", "ready", "ready"]
    score = T.signal_score(F.col("text"), {"x": (("微信", "vx"), 0.25)})
    assert [r.s for r in df.filter("id <> 4").orderBy("id").select(score.alias("s")).collect()] == [0.45, 0.45, 0.0, 0.0]


def test_emphasis_cuts_only_long_timelines_in_stretches(spark):
    chance = random.Random(11)
    rows = [(source, k, chance.randrange(400), chance.choice([None, float("nan"), 1.0, 2.0, 3.0])) for source in ("a", "b", None) for k in range(60 if source == "a" else 12)]
    df = spark.createDataFrame(rows, "source string, id int, at long, score double")
    want = set()
    for source in ("a", "b", None):
        taken = []
        for r in sorted((r for r in rows if r[0] == source), key=lambda r: (r[3] is None or r[3] != r[3], r[3] is not None, -r[3] if r[3] is not None and r[3] == r[3] else 0, r[2], r[1])):
            if len(taken) < 5 and all(abs(r[2] - t[2]) >= 9 for t in taken):
                taken.append(r)
        want |= {(source, t[1]) for t in taken if t[3] is not None and t[3] == t[3]}
    for whole in (10_000, 30):
        got = greedy.emphasis(df, ["source"], 9, 5, whole)
        assert {(r.source, r.id) for r in got.filter("score IS NOT NULL AND NOT isnan(score)").collect()} == want
    assert "ranges" not in plan(greedy.emphasis(df, ["source"], 9, 5)) and "Join" not in plan(greedy.emphasis(df, ["source"], 9, 5))


def test_highlights_score_each_window_once(spark, monkeypatch):
    seen = []
    chosen = greedy.suppressed
    monkeypatch.setattr(planning.greedy, "suppressed", lambda scored, *rest: seen.append(plan(scored)) or chosen(scored, *rest))
    df = spark.createDataFrame([("a", k, 5000 * k, 5000 * k + 5000, f"why {k}?") for k in range(12)], "source string, id int, start long, end long, text string")
    assert planning.highlights(df, ["source"], 20_000, 30_000, 40_000, 2).count() == 2
    assert "regexp_count" not in seen[0].lower() and "Relation" in seen[0]


def test_windows_of_drift_are_joined_by_chunks_and_not_by_frames(spark):
    a = spark.createDataFrame([("x", f, float(f * f % 17)) for f in range(200) if f != 50] + [("x", 60, 99.0)], "source string, frame long, value double")
    b = spark.createDataFrame([("x", f, float((f + 2) * (f + 2) % 17)) for f in range(190)], "source string, frame long, value double")
    cores = drift.probe_cores(a, b, ["source"], 2, 5, 20, 4)
    both = drift._windows(a, b, cores, ["source"], 2, 28, 4, "frame", "value")
    value = {f: float(f * f % 17) for f in range(200)} | {50: 0.0}  # no row: silent; of two rows of a frame the smaller value
    for r in both.collect():
        assert r["__a"] == [value[f] for f in range(r.core - 4, r.core + 24)]
        assert r["__b"] == [float((f + 2) * (f + 2) % 17) for f in range(r.core - 6, r.core + 22)]
    scores = drift.window_scores(a, b, cores, ["source"], 2, 20, 4)
    assert "Window" not in plan(scores)
    assert {r.probe for r in scores.collect()} == set(range(5))
