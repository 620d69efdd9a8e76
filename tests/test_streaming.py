"""Streams against the batch results on the same rows."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweft.operators import greedy, turns
from chronoweft.plans.views import table, units
from chronoweft.streaming import ledger
from chronoweft.streaming.turns import streaming_cooldown, streaming_turns, upsert_stream

SF = "/root/testdata/sf0.001"


def _stream(spark, tmp_path):
    rows = units(spark, SF).withColumn("ts", F.timestamp_millis("start"))
    cut = rows.selectExpr("percentile(start, 0.5)").first()[0]
    for k, part in enumerate((rows.filter(F.col("start") <= cut), rows.filter(F.col("start") > cut))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return rows, stream


def _run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_turns(spark, tmp_path):
    rows, stream = _stream(spark, tmp_path)
    batch = turns.turns(rows, ["source"], 7_200_000)
    last = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("start"), F.desc("end")))
    closed = {tuple(r) for r in batch.withColumn("k", last).filter("k > 1").select("source", "speaker", "start", "end", "units").collect()}
    all_turns = {tuple(r) for r in batch.select("source", "speaker", "start", "end", "units").collect()}
    got = [tuple(r) for r in _run(spark, streaming_turns(stream, 7_200_000, "400 days"), "turns_out").collect()]
    assert len(got) == len(set(got)) and closed <= set(got) <= all_turns


def test_cooldown(spark, tmp_path):
    rows, stream = _stream(spark, tmp_path)
    batch = greedy.cooldown(rows.select("source", "id", F.col("start").alias("at")), ["source"], "at", 86_400_000, ["id"])
    got = _run(spark, streaming_cooldown(stream.select("source", "id", F.col("start").alias("at"), "ts"), 86_400_000), "cooldown_out")
    assert sorted(map(tuple, got.select("source", "id").collect())) == sorted(map(tuple, batch.select("source", "id").collect()))


def test_upsert(spark, tmp_path):
    orders = table(spark, SF, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    for k in range(2):
        orders.filter(F.col("o_orderkey") % 2 == k).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(orders.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    upsert_stream(stream, str(tmp_path / "out"), ["o_custkey"], "o_orderkey", str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "version=1"))
    want = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    assert sorted(map(tuple, got.select("o_custkey", "o_orderkey").collect())) == sorted(map(tuple, want.collect()))


LEDGER = "k long, at long, bucket string"


def _files(root):
    return {str(f.relative_to(root)): f.stat().st_mtime_ns for f in root.rglob("*.parquet")}


def test_ledger_writes_touched_buckets_only(spark, tmp_path):
    path, out = f"file://{tmp_path}/out", tmp_path / "out"
    batches = [[(k, 0, "a") for k in range(50)] + [(None, 0, "a"), (None, 1, "n")], [], [(7, 2, "b"), (7, 1, "old"), (8, -1, "late"), (9, 0, "same")], [(7, 3, None), (60, None, "new"), (None, 2, "m")]]
    frames = [spark.createDataFrame(b, LEDGER) for b in batches]
    state = {}
    for n, (rows, frame) in enumerate(zip(batches, frames)):
        before = _files(out) if out.exists() else {}
        ledger.apply_batch(frame, n, path, ["k"], "at", 16)
        for k, at, v in sorted(rows, key=lambda r: -1 if r[1] is None else r[1]):
            if k not in state or state[k][0] is None or (at is not None and at >= state[k][0]):
                state[k] = (at, v)
        got = sorted(map(tuple, ledger.read_ledger(spark, path, frame.schema).collect()), key=repr)
        assert got == sorted(((k, *v) for k, v in state.items()), key=repr), n
        touched = {r[0] for r in frame.select(ledger.bucket_of(["k"], 16)).collect()}
        written = {f for f, t in _files(out).items() if before.get(f) != t and f.startswith("version")}
        assert {int(f.split("__bucket=")[1].split("/")[0]) for f in written} == touched
    ledger.apply_batch(frames[3], 3, path, ["k"], "at", 16)  # the same batch once more
    again = sorted(map(tuple, ledger.read_ledger(spark, path, frames[3].schema).collect()), key=repr)
    assert again == got


def test_ledger_expires_old_versions(spark, tmp_path):
    path, out = f"file://{tmp_path}/out", tmp_path / "out"
    assert ledger.read_ledger(spark, path, spark.createDataFrame([], LEDGER).schema).count() == 0
    for n in range(5):
        ledger.apply_batch(spark.createDataFrame([(k, n, str(n)) for k in range(20)], LEDGER), n, path, ["k"], "at", 4)
    assert sorted(p.name for p in out.iterdir()) == ["manifest=3", "manifest=4", "version=3", "version=4"]
    unfinished = out / "manifest=5"  # a batch that was lost before its manifest was done
    unfinished.mkdir()
    rows = ledger.read_ledger(spark, path, spark.createDataFrame([], LEDGER).schema).collect()
    assert len(rows) == 20 and {r["at"] for r in rows} == {4}
    with pytest.raises(ValueError):
        ledger.apply_batch(spark.createDataFrame([], LEDGER), 6, path, ["k"], "at", 4, 1)


def test_ledger_stream(spark, tmp_path):
    orders = table(spark, SF, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    for k in range(4):
        orders.filter(F.col("o_orderkey") % 4 == k).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(orders.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ledger.ledger_stream(stream, f"file://{tmp_path}/out", ["o_custkey"], "o_orderkey", str(tmp_path / "state"), 8).awaitTermination()
    got = ledger.read_ledger(spark, f"file://{tmp_path}/out", orders.schema)
    want = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    assert sorted(map(tuple, got.select("o_custkey", "o_orderkey").collect())) == sorted(map(tuple, want.collect()))
