"""Plans, selections, checks and command strings on small literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.functions import layout, selectors
from chronoweft.operators import planning, validation
from chronoweft.sources import commands


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}")


def test_selections(spark):
    df = spark.createDataFrame([("1-3, 2,7",), ("9-8,x, 4",), ("",)], "t string")
    got = df.select(selectors.expanded_ranges(F.col("t")), selectors.selection(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [([1, 2, 3, 2, 7], [1, 2, 3, 7]), ([9, 8, 4], None), ([], [])]


def test_joined_tokens(spark):
    df = one(spark, ["Hello", ",", "( big", "world", ")", "你", "好", "ok", " "], "array<string>")
    assert df.select(selectors.joined_tokens(F.col("v"))).collect()[0][0] == "Hello, ( big world)你好ok"


def test_percentiles_and_fallbacks(spark):
    df = one(spark, [4.0, 1.0, 3.0, 2.0], "array<double>")
    got = df.select(selectors.rank_percentile(F.col("v"), 0.5), selectors.rounded_percentile(F.col("v"), 0.5), selectors.rank_percentile(F.array().cast("array<double>"), 0.5)).collect()[0]
    assert tuple(got) == (2.0, 3.0, 0.0)  # (4 - 1) * 0.5 = 1.5 rounds to 2, the third
    df = spark.createDataFrame([(" ", "b", "inf", 5.0, None, 2.0)], "a string, b string, c string, s double, e double, d double")
    got = df.select(selectors.first_filled(F.col("a"), F.col("b")), selectors.finite(F.col("c")), selectors.reconciled_range(F.col("s"), F.col("e"), F.col("d"))["end"], selectors.seconds_of_range(F.lit(2_000_000))).collect()[0]
    assert tuple(got) == ("b", None, 7.0, 2.0)


def test_layout(spark):
    assert layout.parts_of("one two, three four", 10, "en") == ["one two,", "three four"] and layout.parts_of("abcdefghijkl", 5, "zh") == ["abcde", "fghij", "kl"] and layout.parts_of(None, 5, "en") == []
    assert layout.parts_of("supercalifragilistic words", 12, "en") == ["supercalifra", "gilistic", "words"] and layout.parts_of("一二三四五：六七八九十", 8, "zh") == ["一二三四五：", "六七八九十"]
    w = one(spark, "aa bb cccccc d")
    assert w.select(layout.wrapped_words(F.col("v"), 5)).collect()[0][0] == r"aa bb\Ncccccc\Nd"
    assert one(spark, "今天天气，我们去看 Old Town 吧朋友").select(layout.wrapped_in_two(F.col("v"), 10)).collect()[0][0] == r"今天天气，我们去看 Old\NTown 吧朋友"
    df = one(spark, "Teh cat saw teh tehran 微新")
    assert df.select(layout.corrected(F.col("v"), [("teh", "the"), ("微新", "微信")])).collect()[0][0] == "the cat saw the tehran 微信"


def test_scene_snap_keeps_what_would_be_too_long(spark):
    c = spark.createDataFrame([("a", 1, 10, 20), ("a", 2, 100, 120)], "source string, id int, start long, end long")
    b = spark.createDataFrame([("a", 8), ("a", 22), ("a", 95), ("a", 200)], "source string, at long")
    assert rows(planning.scene_snapped(c, b, ["source"], 5, 14), "id", "snapped_start", "snapped_end") == [(1, 8, 22), (2, 100, 120)]
    assert rows(planning.scene_snapped(c, b, ["source"], 5, 13), "id", "snapped_start", "snapped_end") == [(1, 10, 20), (2, 100, 120)]


def test_word_starts(spark):
    words = spark.createDataFrame([("a", 10, 20), ("a", 30, 40)], "source string, start long, end long")
    cuts = spark.createDataFrame([("a", 1, 15), ("a", 2, 25), ("a", 3, 44), ("a", 4, 99), ("a", 5, 10)], "source string, id int, at long")
    got = rows(planning.word_start(cuts, words, ["source"], 14, 7), "id", "moved", "reason")
    assert got == [(1, 10, "word_start"), (2, 30, "next_word_start"), (3, 30, "nearest_word_start"), (4, 99, "unchanged"), (5, 10, "next_word_start")]


def test_chapters(spark):
    marks = spark.createDataFrame([("a", 5, "x"), ("a", 8, "y"), ("a", 30, "z"), ("a", 99, "w")], "source string, start long, title string")
    lengths = spark.createDataFrame([("a", 60)], "source string, duration long")
    assert rows(planning.chapters(marks, lengths, ["source"], 10, 9), "number", "start", "end", "title") == [(1, 0, 30, "x"), (2, 30, 60, "z")]


def test_highlights_do_not_overlap(spark):
    texts = ["Why do people fail?", "Because of one mistake.", "Here is the step.", "and then", "nothing", "more nothing"]
    df = spark.createDataFrame([("a", k, k * 10_000, (k + 1) * 10_000, t) for k, t in enumerate(texts)], "source string, id int, start long, end long, text string")
    got = planning.highlights(df, ["source"], 20_000, 30_000, 40_000, 2).orderBy("rank").collect()
    assert got[0]["start"] == 0 and got[0]["score"] > got[1]["score"]
    shared = max(0, min(got[0]["end"], got[1]["end"]) - max(got[0]["start"], got[1]["start"]))
    assert shared <= 0.5 * min(r["end"] - r["start"] for r in got)


def test_clip_references(spark):
    clips = spark.createDataFrame([("a", 1, "1", None, None), ("a", 2, "9", None, None), ("a", 3, "1", 50, None)], "source string, number int, segment_id string, start long, end long")
    known = spark.createDataFrame([("a", 1, 0, 10)], "source string, id int, start long, end long")
    assert rows(planning.clip_references(clips, known, ["source"]), "number", "problem") == sorted([(1, None), (2, "segment_not_found"), (3, "empty_range")])


def test_checks(spark):
    media = spark.createDataFrame([(1, -16.0, -1.5, 5.0, 0.0), (2, None, 0.0, 5.0, 9.0)], "id int, integrated double, peak double, range double, longest_silence double")
    assert rows(validation.measured(media, ["id"], -16, 1, -1, 15, 5), "id", "kind", "severity") == [(2, "long_silence", "warn"), (2, "not_measured", "block"), (2, "true_peak", "block")]
    outputs = spark.createDataFrame([(1, "h264", 10, 20, 30.0, 5, 9.0, 10, 20, 30.0, 9.05), (2, "vp9", 10, 20, 25.0, 500, 9.0, 20, 10, 30.0, 12.0)], "id int, codec string, width int, height int, fps double, bytes long, duration double, want_width int, want_height int, want_fps double, want_duration double")
    assert rows(validation.encoded(outputs, ["id"], ["h264"], 100), "id", "kind") == [(2, "codec"), (2, "duration"), (2, "rate"), (2, "size"), (2, "too_large")]
    assert one(spark, 0.0, "double").select(validation.bitrate(F.lit(1000), F.col("v"), 1)).collect()[0][0] is None
    scores = spark.createDataFrame([(1, 90.0, 100.0), (2, 70.0, 70.0), (3, 10.0, 10.0), (4, 101.0, 1.0), (5, None, 1.0)], "id int, a double, b double")
    assert rows(validation.scored(scores, {"a": 1, "b": 1}), "id", "verdict") == [(1, "ready"), (2, "review"), (3, "blocked"), (4, "invalid"), (5, "invalid")]


def test_commands(spark):
    got = one(spark, "it's here").select(commands.command([F.lit("ffmpeg"), F.lit("-i"), F.col("v")]), commands.grade_filter(F.lit(9.0), F.lit(1.0), F.lit(-1.0))).collect()[0]
    assert tuple(got) == ("ffmpeg -i 'it'\\''s here'", "eq=brightness=0.300:contrast=1.000:saturation=0.000")
    boxes = spark.createDataFrame([("a", 0, 1500, 1.0, 2.0, 11.0, 22.0)], "source string, start long, end long, x1 double, y1 double, x2 double, y2 double")
    assert rows(commands.box_filters(boxes, ["source"]), "text") == [("drawbox=x=1:y=2:w=10:h=20:t=fill:enable='between(t,0.000,1.500)'",)]
