"""What the findings of the fourth round asked for: results on odd rows, and plans whose work grows with the input."""

from __future__ import annotations

import hashlib
import itertools
import json
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from chronoweft.operators import alignment, intervals, revisions
from chronoweft.operators.graph import cut_lineage


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_complement_of_empty_and_reversed_intervals_and_of_a_null_key(spark):
    rows = [("a", 10, 20), ("a", 40, 40), ("a", 60, 50), ("a", None, 70), ("a", 80, None), (None, 30, 100), ("b", 5, 5)]
    df = spark.createDataFrame(rows, "source string, start long, end long")
    lengths = spark.createDataFrame([("a", 90), (None, 90), ("b", 90), ("c", 90)], "source string, duration long")
    got = intervals.complement(df, lengths, ["source"]).collect()
    assert sorted((r.source or "", r.start, r.end) for r in got) == [("", 0, 30), ("a", 0, 10), ("a", 20, 90), ("b", 0, 90), ("c", 0, 90)]


def test_alignments_of_many_pairs_at_once_are_those_of_each_pair(spark, monkeypatch):
    chance = random.Random(4)
    some = lambda most: chance.choices("abcdé", k=chance.randrange(most))
    pairs = [(some(9), some(14)) for _ in range(700)] + [(some(40), some(90)) for _ in range(30)] + [([], []), ([], ["a"]), (["a"], []), (["a"] * 200, ["b"] * 300 + ["a"] * 150)]

    def plain(a, b):
        held = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            held[i + 1][j + 1] = max(0, held[i][j] + (2 if a[i] == b[j] else -1), held[i][j + 1] - 1, held[i + 1][j] - 1)
        best = max(map(max, held))
        if not best:
            return (0,) * 6
        j, i = next((j, i) for j in range(len(b) + 1) for i in range(len(a) + 1) if held[i][j] == best)
        at, equal = (i, j), 0
        while held[i][j]:
            same = a[i - 1] == b[j - 1]
            if held[i][j] == held[i - 1][j - 1] + (2 if same else -1):
                i, j, equal = i - 1, j - 1, equal + same
            elif held[i][j] == held[i - 1][j] - 1:
                i -= 1
            else:
                j -= 1
        return i, at[0], j, at[1], best, equal

    want = [plain(*p) for p in pairs]
    words = pa.list_(pa.string())
    for cells in (1, 3000, alignment.CELLS):
        monkeypatch.setattr(alignment, "CELLS", cells)
        assert [tuple(r) for r in alignment.local_alignments(pa.array([a for a, _ in pairs], words), pa.array([b for _, b in pairs], words)).tolist()] == want
    # Forty thousand pairs took forty seconds one by one.
    a, b = "w1 w2 w3 w4 w5 w6 w7 w8 w9".split() * 4, "x y w3 w4 w5 z".split() * 14
    began = time.process_time()
    assert len(set(map(tuple, alignment.local_alignments(pa.array([a] * 40_000, words), pa.array([b] * 40_000, words)).tolist()))) == 1
    assert time.process_time() - began < 20


def test_paths_start_no_python_for_each_target(spark):
    texts = [(k, f"w{k} one two three four w{k + 1} five six") for k in range(40)]
    targets, sources = spark.createDataFrame(texts, "item int, text string"), spark.createDataFrame(texts, "take_of int, text string")
    got = alignment.assemble(alignment.takes(targets, sources, "item", "take_of"), targets, "item", "take_of")
    assert "InPandas" not in plan(got) and "REPARTITION_BY_NUM" in plan(got)
    assert sorted((r.item, r["take"], r.take_of, r.t_from, r.t_to, r.coverage) for r in got.collect()) == [(k, 1, k, 0, 8, 100.0) for k in range(40)]


def leafwise(documents, patches, by):
    """(json, issues) by document with the operators on leaves, step by step."""
    parts = cut_lineage(revisions.leaves(documents, by), "leaves")
    asked = cut_lineage(patches.withColumn("path", revisions.steps(F.col("path"))), "patches")
    checked = cut_lineage(revisions.audited(parts, asked, by), "audited")
    issues = {r[0]: ",".join(sorted(set(filter(None, r[1])))) for r in checked.groupBy(*by).agg(F.collect_set("issue")).collect()}
    after = revisions.rebuilt(revisions.closed_up(cut_lineage(revisions.applied(parts, checked, by), "applied"), by), by)
    return {r[0]: (r.json, issues.get(r[0], "") if r[0] is not None else "") for r in after.collect()}


def test_revisions_in_one_pass_are_those_by_leaves(spark):
    chance = random.Random(9)
    some = lambda: chance.choice([1, -0.5, 1e30, 12345678901234567890123, "x", 'q"\\\n\u0001\u001f\x7f\\u001f', "é日😀", True, None, {}, [], [1, {"b": []}], {"k": {"l": 2}}])

    def made(depth=0):
        kind = chance.randrange(3) if depth < 3 else 0
        return some() if not kind else {chance.choice(["a", "b", "é", "k\u0002", 'q"']) + str(k): made(depth + 1) for k in range(chance.randrange(4))} if kind == 1 else [made(depth + 1) for _ in range(chance.choice([0, 1, 3, 11]))]

    def places(v, path="$"):
        yield path, v
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            yield from places(x, path + (f".{k}" if isinstance(v, dict) else f"[{k}]"))

    docs, patches = [(1000, None), (1001, "no json"), (1002, " 7 "), (1003, "null"), (None, '{"a":1}')], [(None, 1, "$.a", "1", "2"), (1001, 1, "$", None, "1"), (1002, 1, "$", "7.0", None), (1003, 1, None, None, "1"), (1003, 2, None, "1", "2"), (5000, 1, "$", None, "1")]
    for doc in range(150):
        value = made()
        docs.append((doc, json.dumps(value, ensure_ascii=doc % 2 == 0, indent=doc % 3 or None)))
        every = list(places(value))
        for number in range(chance.choice([0, 1, 1, 1, 2, 3])):
            path, now = chance.choice(every)
            before, after = json.dumps(now), json.dumps(some())
            kind = chance.randrange(9)
            if kind == 0:
                before = json.dumps(some())
            elif kind == 1:
                after = chance.choice([before, "{", "no json"])
            elif kind in (2, 3):
                after = None
            elif kind == 4:
                before = None
            elif kind in (5, 6) and isinstance(now, dict) and now:
                path, before = path + chance.choice([".new", ".new.deep[3].er", ".z[007]"]), None
            elif kind in (5, 6) and isinstance(now, list) and now:
                path, before = f"{path}[{len(now) + chance.randrange(3)}]" + chance.choice(["", ".in", "[2]"]), None
            elif kind in (5, 6) and now in ({}, []):
                path, before = path + chance.choice([".new", "[4]"]), None
            elif kind == 7:
                path += chance.choice([".none", "[99]"])
            patches.append((doc, number, path, before, after))
    documents = spark.createDataFrame(docs, "doc long, json string")
    asked = spark.createDataFrame(patches, "doc long, number long, path string, before string, after string")
    got = revisions.revised(documents, asked, ["doc"])
    assert "MapInArrow" in plan(got)
    found = got.collect()
    assert len(found) > 120 and {r.issues for r in found} >= {"", "stale", "missing", "exists", "overlap", "no_change", "invalid_json"}
    # By leaves, a document that is replaced by an empty array as a whole is lost.
    assert {r.doc: (r.json, r.issues) for r in found} == {**leafwise(documents, asked, ["doc"]), 115: ("[]", "")}
    assert all(r.digest == hashlib.sha256(r.json.encode()).hexdigest() for r in found)


def test_a_part_in_the_way_of_one_that_is_added_is_told(spark):
    documents = spark.createDataFrame([(k, '{"a":5,"b":[1],"c":{"d":null}}') for k in range(6)] + [(6, "[" * 400 + "]" * 400)], "doc int, json string")
    patches = spark.createDataFrame([(0, 1, "$.a.x", None, "1"), (1, 1, "$.b.x", None, "1"), (2, 1, "$.c[0]", None, "1"), (3, 1, "$.c.d.e", None, "1"), (4, 1, "$.b[0]", "1", None), (4, 2, "$.b.x", None, "1"), (6, 1, "$[0][0]", None, "1")], "doc int, number int, path string, before string, after string")
    got = {r.doc: (r.json, r.issues) for r in revisions.revised(documents, patches, ["doc"]).collect()}
    kept = '{"a":5,"b":[1],"c":{"d":null}}'
    assert got == {0: (kept, "exists"), 1: (kept, "exists"), 2: (kept, "exists"), 3: (kept, "exists"), 4: ('{"a":5,"b":{"x":1},"c":{"d":null}}', ""), 5: (kept, ""), 6: ("[" * 400 + "]" * 400, "exists")}
