"""Operators on small literal rows, with the edge cases that they must keep."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from chronoweft.functions import geometry, timecode
from chronoweft.functions import text as T
from chronoweft.operators import catalog, findings, graph, greedy, intervals, joins, ledger, signal, similarity, timeline, turns
from chronoweft.sources import logs, sinks


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())


def spans(spark, *items):
    return spark.createDataFrame([("a", *i) for i in items], "source string, start long, end long")


def lengths(spark, duration=100):
    return spark.createDataFrame([("a", duration)], "source string, duration long")


def test_merge_touching_and_empty(spark):
    df = spans(spark, (0, 10), (10, 20), (25, 25), (30, 40), (32, 35))
    assert rows(intervals.merge(df, ["source"])) == [("a", 0, 20, 2), ("a", 30, 40, 2)]
    assert rows(intervals.merge(df, ["source"], stretch=7)) == [("a", 0, 20, 2), ("a", 30, 40, 2)]
    assert rows(intervals.merge(df, ["source"], gap=10)) == [("a", 0, 40, 4)]
    assert rows(intervals.merge(df.limit(0), ["source"])) == []


def test_complement_and_keep(spark):
    df = spans(spark, (10, 20), (15, 30), (90, 120))
    assert rows(intervals.complement(df, lengths(spark), ["source"])) == [("a", 0, 10), ("a", 30, 90)]
    assert rows(intervals.complement(df.limit(0), lengths(spark), ["source"])) == [("a", 0, 100)]
    assert rows(intervals.keep_segments(spans(spark, (10, 20), (50, 53)), lengths(spark), ["source"], pad=2)) == [("a", 0, 12), ("a", 18, 100)]
    plan = intervals.cut_plan(spans(spark, (0, 50)), lengths(spark), ["source"]).collect()[0]
    assert (plan["kept"], plan["removed"], plan["status"]) == (50, 50, "blocked")
    assert intervals.cut_plan(spans(spark, (0, 50)), lengths(spark), ["source"], allow_over=True).collect()[0]["status"] == "review"


def test_runs_and_spikes(spark):
    df = spark.createDataFrame([("a", k, f) for k, f in enumerate([True, True, False, True, None])], "source string, n int, f boolean")
    assert rows(intervals.longest_run(df, ["source"], ["n"], F.col("f"))) == [("a", 2, 2)]
    flat = spark.createDataFrame([("a", k, 0.9 if k == 3 else 0.0) for k in range(7)], "source string, n int, score double")
    got = intervals.local_spikes(flat, ["source"], ["n"], "score").collect()
    assert [(r["n"], r["ratio"]) for r in got] == [(3, 255.0)]


def test_turns_are_broken_by_others(spark):
    df = spark.createDataFrame([("a", 1, 0, 10, "x"), ("a", 2, 11, 12, "y"), ("a", 3, 13, 20, "x"), ("a", 4, 21, 22, "x"), ("a", 5, 90, 91, "x")], "source string, id int, start long, end long, speaker string")
    assert rows(turns.turns(df, ["source"], 5), "speaker", "start", "end", "units") == [("x", 0, 10, 1), ("x", 13, 22, 2), ("x", 90, 91, 1), ("y", 11, 12, 1)]


def test_overlap_is_half_open(spark):
    a = spark.createDataFrame([("a", 1, 0, 10)], "source string, id int, start long, end long")
    b = spark.createDataFrame([("a", 1, 10, 20), ("a", 2, 9, 11), ("a", 3, 5, 5), ("b", 4, 0, 10)], "source string, id int, start long, end long")
    for width in (1, 3, 100):
        assert rows(joins.overlap_join(a, b, ["source"], width), "l_id", "r_id") == [(1, 2)]


def test_speaker_ties_go_to_the_first(spark):
    units = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 50, 60)], "source string, id int, start long, end long")
    spoken = spark.createDataFrame([("a", 0, 5, "z"), ("a", 5, 10, "b")], "source string, start long, end long, speaker string")
    got = {r["id"]: r for r in joins.assign_speakers(units, spoken, ["source"], 10).collect()}
    assert (got[1]["assigned"], got[1]["coverage"], got[1]["warnings"]) == ("z", 1.0, "mixed")
    assert (got[2]["assigned"], got[2]["warnings"]) == ("unknown", "unlabeled")


def test_nearest_takes_the_earlier_of_two(spark):
    cuts = spark.createDataFrame([("a", 10), ("a", 100), ("b", 1)], "source string, at long")
    beats = spark.createDataFrame([("a", 8), ("a", 12)], "source string, at long")
    assert rows(joins.nearest(cuts, beats, ["source"]), "at", "nearest") == sorted([(10, 8), (100, 12), (1, None)], key=lambda x: x[0])
    assert rows(joins.snap(cuts, beats, ["source"], 5), "at", "snapped") == [(1, 1), (10, 8), (100, 100)]


def test_point_in_closed_interval(spark):
    points = spark.createDataFrame([("a", 10), ("a", 11)], "source string, at long")
    scenes = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 10, 10)], "source string, id int, start long, end long")
    assert rows(joins.within(points, scenes, ["source"], 4), "at", "interval") == [(10, 1), (11, None)]


def test_greedy_choices(spark):
    df = spark.createDataFrame([("a", k, t) for k, t in enumerate([0, 2, 5, 6, 11])], "source string, id int, at long")
    assert rows(greedy.cooldown(df, ["source"], "at", 5, ["id"]), "at") == [(0,), (5,), (11,)]
    assert rows(greedy.cooldown(df, ["source"], "at", 5, ["id"], most=2), "at") == [(0,), (5,)]
    assert rows(greedy.spaced(df.select("source", "at"), lengths(spark, 13), ["source"], 4), "at") == [(5,)]
    packs = greedy.packed(df, ["source"], ["id"], F.col("at"), 8)
    assert [r["pack"] for r in packs.orderBy("id").collect()] == [0, 0, 0, 1, 2]


def test_suppression(spark):
    df = spark.createDataFrame([("a", 1, 0, 10, 5.0), ("a", 2, 4, 14, 9.0), ("a", 3, 20, 30, 1.0)], "source string, id int, start long, end long, score double")
    assert rows(greedy.suppressed(df, ["source"], 0.5), "id") == [(2,), (3,)]
    assert rows(greedy.suppressed(df, ["source"], 0.6), "id") == [(1,), (2,), (3,)]


def test_phrases_break_on_gap_speaker_and_length(spark):
    df = spark.createDataFrame([("a", 1, 0, 10, "x", "one"), ("a", 2, 11, 20, "x", "two"), ("a", 3, 21, 30, "y", "three"), ("a", 4, 900, 910, "y", "four")], "source string, id int, start long, end long, speaker string, text string")
    assert rows(greedy.phrases(df, ["source"], 500, 220), "id", "phrase") == [(1, 1), (2, 1), (3, 2), (4, 3)]
    assert rows(greedy.phrases(df, ["source"], 500, 5), "id", "phrase") == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_tracks_and_boxes(spark):
    box = "source string, id int, label string, at double, x1 double, y1 double, x2 double, y2 double"
    df = spark.createDataFrame([("a", 1, "cat", 0.0, 0.0, 0.0, 10.0, 10.0), ("a", 2, "cat", 1.0, 1.0, 0.0, 11.0, 10.0), ("a", 3, "cat", 1.0, 80.0, 80.0, 90.0, 90.0), ("a", 4, "cat", 99.0, 1.0, 0.0, 11.0, 10.0)], box)
    assert rows(greedy.tracks(df, ["source"], 140.0, 2.0, 0.3), "id", "track") == [(1, 1), (2, 1), (3, 2), (4, 3)]
    timed = df.filter("id < 3").withColumn("start", F.col("at")).withColumn("end", F.col("at") + 5)
    assert rows(greedy.merged_boxes(timed, ["source"], 0.7), "start", "end", "x2", "n") == [(0.0, 6.0, 11.0, 2)]


def test_repeats_keep_the_longer(spark):
    df = spark.createDataFrame([("a", 1, 0, 10, "helloworld"), ("a", 2, 11, 20, "helloworldagain"), ("a", 3, 21, 30, "other text")], "source string, id int, start long, end long, normal string")
    assert rows(greedy.adjacent_repeats(df, ["source"], 0.6), "id", "keep") == [(1, 2)]


def test_components_and_keepers(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 9), (9, 7), (5, 5)], "a long, b long")
    assert rows(graph.components(edges)) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)]
    items = spark.createDataFrame([(1, 3), (2, 9), (3, 9), (4, 1)], "id long, q int")
    assert rows(graph.keepers(items, graph.components(edges), [F.desc("q")]).filter("keep"), "id") == [(2,), (4,)]


def test_signatures(spark):
    df = spark.createDataFrame([(1, 0), (2, 7), (3, -1), (4, -2)], "id long, signature long")
    assert rows(similarity.signature_pairs(df, 3)) == [(1, 2, 3), (3, 4, 1)]
    one = spark.createDataFrame([(0, None, [0.0, 0.0, 0.0], [255.0, 255.0, 255.0])], "a long, b long, x array<double>, y array<double>")
    assert one.select(geometry.hamming(F.col("a"), F.col("b"))).collect()[0][0] == 64
    assert one.select(similarity.frame_distance(F.col("a"), F.col("a"), F.col("x"), F.col("y"))).collect()[0][0] == 32


def test_match_score(spark):
    a, b = "the quick brown fox", "a quick brown dog"
    df = spark.createDataFrame([(a, b), (a, a), (a, "")], "a string, b string")
    got = [r[0] for r in df.select(similarity.match_score(F.col("a"), F.col("b"))).collect()]
    m = SequenceMatcher(None, a, b, autojunk=False)
    matched = sum(x.size for x in m.get_matching_blocks())
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    want = 100 * (0.45 * m.ratio() + 0.25 * matched / len(a) + 0.15 * matched / len(b) + 0.1 * len(grams(a) & grams(b)) / len(grams(a) | grams(b)) + 0.05 * len(b) / len(a))
    assert abs(got[0] - want) < 0.01 and got[1:] == [100.0, 0.0]


def test_lag_and_drift(spark):
    series = [1.0, 5.0, 2.0, 8.0, 1.0, 1.0, 4.0]
    a = spark.createDataFrame([("a", k, v) for k, v in enumerate(series)], "source string, frame long, value double")
    best = signal.best_lag(signal.lag_scores(a, a.withColumn("frame", F.col("frame") + 2), ["source"], 4), ["source"]).collect()[0]
    assert best["lag"] == 2 and best["score"] == 1.0
    probes = spark.createDataFrame([("a", float(t), 0.5 + 0.001 * t, 1.0) for t in (0, 100, 200, 300)] + [("b", 0.0, 1.0, 1.0), ("b", 1.0, 2.0, 1.0), ("b", 2.0, 3.0, 1.0)], "source string, at double, offset double, confidence double")
    got = {r["source"]: r for r in signal.drift(probes, ["source"], 0.5, 100, 0.01).collect()}
    assert got["a"]["status"] == "fitted" and abs(got["a"]["slope"] - 0.001) < 1e-9 and got["b"]["status"] == "too_few"


def test_findings(spark):
    cues = spark.createDataFrame([("a", 1, 0, 100, "hi"), ("a", 2, 50, 2050, ""), ("a", 3, 40, 40, "x")], "source string, id int, start long, end long, text string")
    got = rows(findings.cue_checks(cues, ["source"]), "id", "kind")
    assert got == [(1, "cps_high"), (1, "flash_cue"), (2, "cue_overlap"), (2, "empty_text"), (3, "non_monotonic_order"), (3, "non_positive_duration")]
    status = findings.summary(findings.cue_checks(cues, ["source"]), cues, ["source"]).collect()[0]
    assert status["status"] == "blocked"


def test_timecodes(spark):
    df = spark.createDataFrame([(3_661_999,), (59_996,), (0,)], "ms long")
    got = df.select(timecode.srt_time(F.col("ms")), timecode.ass_time(F.col("ms")), timecode.timecode(timecode.seconds_to_frames(F.col("ms") / 1000, 25), 25)).collect()
    assert [tuple(r) for r in got] == [("01:01:01,999", "1:01:02.00", "01:01:02:00"), ("00:00:59,996", "0:01:00.00", "00:01:00:00"), ("00:00:00,000", "0:00:00.00", "00:00:00:00")]
    clock = spark.createDataFrame([("1:02:03.5",), ("2:03",), ("7",), ("x",)], "t string")
    assert [r[0] for r in clock.select(timecode.parse_clock(F.col("t"))).collect()] == [3723.5, 123.0, 7.0, None]


def test_text_functions_with_cjk(spark):
    df = spark.createDataFrame([("现在用GPT-5 加V 二维码",), (None,), ("plain",)], "t string").withColumn("k", F.lit(1))
    assert df.filter("t IS NOT NULL").select(T.tokens(F.col("t"))).collect()[0][0][:4] == ["现", "在", "用", "gpt"]
    found = rows(T.violations(df, ["k"], "t"), "category", "matched")
    assert ("diversion-qrcode", "二维码") in found and ("diversion-wechat", "加V") in found
    title = spark.createDataFrame([(1, "wow!!!")], "k int, t string")
    assert rows(T.violations(title, ["k"], "t", context="title"), "category") == [("punct-run",)]
    assert df.select(T.infer_language(F.col("t"))).collect()[0][0] == "zh"


def test_logs(spark):
    lines = spark.createDataFrame([("a", 1, "x silence_start: 1.5"), ("a", 2, "x silence_end: 3 | silence_duration: 1.5"), ("a", 3, "silence_start: 8")], "source string, n int, line string")
    assert rows(logs.detected_spans(lines, lengths(spark, 10), ["source"], "silence_start", "silence_end")) == [("a", 1.5, 3.0), ("a", 8.0, 10.0)]
    frames = spark.createDataFrame([("a", 1, "pts_time:1.0"), ("a", 2, "YAVG=10"), ("a", 3, "YLOW=1"), ("a", 4, "pts_time:2.0"), ("a", 5, "YAVG=11")], "source string, n int, line string")
    assert rows(logs.frame_values(frames, ["source"], ["YAVG", "YLOW"])) == [("a", 1.0, 10.0, 1.0)]
    text = spark.createDataFrame([('{"input_thresh" : "-70.1"} {"input_thresh" : "-33.5"} I: -16.2 LUFS LRA: 5.0 LU Peak: -1.5 dBFS black_start:1 black_end:2.5 black_duration:1.5 pts_time:3 pts_time:1 pts_time:3',)], "t string")
    got = text.select(logs.noise_threshold(F.col("t"), -40.0), logs.loudness(F.col("t")), logs.black_spans(F.col("t")), logs.scene_times(F.col("t"))).collect()[0]
    assert got[0] == -33.5 and tuple(got[1]) == (-16.2, 5.0, -1.5) and tuple(got[2][0]) == (1.0, 2.5, 1.5) and got[3] == [1.0, 3.0]
    speakers = spark.createDataFrame([("a", "SPEAKER f 1 0.5 2.0 <NA> <NA> bob <NA>"), ("a", "junk")], "source string, line string")
    assert rows(logs.rttm(speakers, ["source"])) == [("a", 0.5, 2.5, "bob")]


def test_words_fall_back_to_segments(spark):
    kind = "source string, segments array<struct<id:string,start:double,end:double,text:string,speaker:string,words:array<struct<word:string,start:double,end:double,speaker:string,type:string>>>>"
    df = spark.createDataFrame([("a", [("s1", 0.0, 1.0, "hi there", "x", [("hi", 0.1, None, None, None), (" ", 0.2, 0.3, None, "spacing")]), ("s2", 1.0, 2.0, "yo", "y", None)])], kind)
    assert rows(logs.transcript_units(df, ["source"]), "segment", "start", "end", "text", "speaker") == [("s1", 0.1, 1.0, "hi", "x"), ("s2", 1.0, 2.0, "yo", "y")]


def test_srt_round_trip(spark):
    cues = spark.createDataFrame([("a", 0, 1500, "one\ntwo"), ("a", 2000, 3000, "three")], "source string, start long, end long, text string")
    assert rows(logs.srt_cues(sinks.srt(cues, ["source"]), ["source"]), "number", "start", "end", "text") == [(1, 0, 1500, "one\ntwo"), (2, 2000, 3000, "three")]


def test_ledger(spark):
    history = spark.createDataFrame([("f", 1, None, "v1"), ("f", 3, "v1", "v2"), ("g", 5, "old", "new")], "artifact string, seq int, before string, after string")
    assert rows(ledger.state_at(history, ["artifact"], 2)) == [("f", "v1"), ("g", "old")]
    assert rows(ledger.broken_chain(history, ["artifact"]), "artifact", "seq") == [("f", 3), ("g", 5)]
    a = spark.createDataFrame([("x", 1), ("y", None), ("w", 2)], "path string, sha int")
    b = spark.createDataFrame([("x", 2), ("y", None), ("z", 3)], "path string, sha int")
    assert rows(ledger.compared(a, b, ["path"], "sha")) == [("w", "missing"), ("x", "changed"), ("y", "same"), ("z", "extra")]


def test_catalog(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "2", 5)], "path string, name string, at int")
    new = spark.createDataFrame([("a", "", 1), ("b", "older", 4), ("c", "3", 1)], "path string, name string, at int")
    assert rows(catalog.upsert(old, new, ["path"], "at"), "path", "name") == [("a", ""), ("b", "2"), ("c", "3")]
    assert rows(catalog.merged_rows(old, new, ["path"]), "path", "name") == [("a", "1"), ("b", "older"), ("c", "3")]
    kinds = spark.createDataFrame([("x/y.MOV",), ("z",)], "p string").select(catalog.media_kind(F.col("p"))).collect()
    assert [r[0] for r in kinds] == ["video", "other"]


def test_timeline(spark):
    clips = spark.createDataFrame([("a", 1, 0, 1000), ("a", 2, 5000, 5010), ("a", 3, 2000, 3000)], "source string, id int, start long, end long")
    assert rows(timeline.edit_events(clips, ["source"], ["id"]), "number", "source_in", "record_in", "record_out") == [(1, 0, 0, 25), (2, 50, 25, 50)]
    names = spark.createDataFrame([("a/b c-1.final.mp4",), ("...",)], "p string").select(timeline.reel_name(F.col("p"))).collect()
    assert [r[0] for r in names] == ["BC1FINAL", "AX"]


def _long_conversation(spark, tmp_path):
    """1,200 turns of ten seconds in one conversation: numbers go past 999, and times past an hour."""
    rows = spark.range(1200).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("words "), 30).alias("text"))
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_edit_list_has_every_event(spark, tmp_path):
    from chronoweft.plans import registry

    got = {r["number"]: r["line"] for r in registry.queries()["edit_list_lines"](spark, _long_conversation(spark, tmp_path)).collect()}
    assert len(got) == 1200 and all(line.split(" ")[0] == f"{number:03d}" for number, line in got.items())


def test_chapters_go_past_an_hour(spark, tmp_path):
    from chronoweft.plans import registry

    (got,) = registry.queries()["chapter_list"](spark, _long_conversation(spark, tmp_path)).collect()
    lines = got["text"].split("\n")
    assert len(lines) == 1200 and lines[0] == "0:00 user" and lines[359] == "59:50 assistant" and lines[360] == "1:00:00 user" and lines[-1] == "3:19:50 assistant"


def test_gate_on_whole_texts(spark, tmp_path):
    from chronoweft.plans import registry

    plain = "nothing to see in this text " * 5
    texts = [plain, plain + "www.shop.example", plain + "call 13812345678 now", plain + "my vx is here", plain + "qq", "short", "well...", None, plain * 7]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(registry.queries()["guard_gate"](spark, str(tmp_path)).collect())
    assert got == {0: "ready", 1: "blocked", 2: "blocked", 3: "blocked", 4: "blocked", 5: "ready", 6: "ready", 7: "ready", 8: "review"}


def test_whole_turns_are_compared(spark, tmp_path):
    from chronoweft.plans import registry

    texts = ["one two three four five six seven " + "left " * 40 + "shared", "ab " * 60 + "élan Shared", "x", "y zebra"]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    grams = [{t.lower()[i : i + 2] for i in range(len(t) - 1)} or {t} for t in texts]
    got = {r["turn"]: r["likeness"] for r in registry.queries()["bigram_jaccard_turns"](spark, str(tmp_path)).collect()}
    assert got == {k: len(grams[k] & grams[k + 1]) / len(grams[k] | grams[k + 1]) for k in range(3)}
    need = {r["id"]: r["need"] for r in registry.queries()["transition_bridges"](spark, str(tmp_path)).collect()}
    assert (need[0], need[2]) == (2.5, 2.0)  # the word that turns 0 and 1 share stands at their ends
