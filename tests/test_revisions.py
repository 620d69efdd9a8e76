"""Edits of nested documents against Python's own dictionaries and lists."""

from __future__ import annotations

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from chronoweft.operators import revisions

BY = ["doc"]
plain = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def made_up(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind < 4:
        return rng.choice([1, -7, 2.5, "text", 'quo"te\n', "é日", "", True, False, None, {}, []])
    if kind < 6:
        return {rng.choice("abcdeé_ ") + str(k): made_up(rng, depth + 1) for k in range(rng.randrange(4))}
    return [made_up(rng, depth + 1) for _ in range(rng.choice([0, 2, 12]))]


def docs_of(spark, values):
    return spark.createDataFrame([(k, v if isinstance(v, str) or v is None else json.dumps(v)) for k, v in values], "doc long, json string").withColumn("path", F.lit("clash")).withColumn("value", F.lit("clash"))


def test_leaves_and_back(spark):
    rng = random.Random(3)
    values = [(k, made_up(rng)) for k in range(60)]
    values = [(k, v if isinstance(v, (dict, list)) else [v]) for k, v in values]
    got = {r.doc: r.json for r in revisions.rebuilt(revisions.leaves(docs_of(spark, values), BY), BY).collect()}
    assert got == {k: plain(v) for k, v in values}
    odd = docs_of(spark, [(1, None), (2, "no json"), (3, "7"), (4, "null"), (5, "{}")])
    assert {r.doc: r.json for r in revisions.rebuilt(revisions.leaves(odd, BY), BY).collect()} == {3: "7", 4: "null", 5: "{}"}
    assert revisions.rebuilt(revisions.leaves(odd.limit(0), BY), BY).count() == 0


def test_deep_documents(spark):
    value = "bottom"
    for k in range(40):
        value = {"a": value} if k % 2 else [value]
    got = revisions.rebuilt(revisions.leaves(docs_of(spark, [(1, value)]), BY), BY).first().json
    assert got == plain(value)


DOC = {"title": "one", "lines": [{"n": 1, "tags": ["x", "y"]}, {"n": 2, "tags": []}], "meta": {"by": None}}


def patch(spark, rows):
    return spark.createDataFrame([(d, n, p, None if b is ... else json.dumps(b), None if a is ... else json.dumps(a)) for d, n, p, b, a in rows], "doc long, number long, path string, before string, after string")


@pytest.fixture
def documents(spark):
    return docs_of(spark, [(k, DOC) for k in range(12)])


def test_patches_apply_and_revert(spark, documents):
    rows = [(0, 1, "$.title", "one", {"de": "eins"}), (0, 2, "$.lines[0].tags[1]", "y", "z"), (1, 1, "$.lines[0]", DOC["lines"][0], ...), (2, 1, "$.meta.by", None, 5), (3, 1, "$.new", ..., [1, {"k": []}]), (4, 1, "$.lines[1].tags[0]", ..., "first"), (5, 1, "$.meta.by", None, ...), (6, 1, "$.lines[0].tags", ["x", "y"], ["only"])]
    patches = patch(spark, rows)
    got = {r.doc: r for r in revisions.revised(documents, patches, BY).collect()}
    expected = {k: copy.deepcopy(DOC) for k in range(12)}
    expected[0]["title"], expected[0]["lines"][0]["tags"][1] = {"de": "eins"}, "z"
    del expected[1]["lines"][0]
    expected[2]["meta"]["by"] = 5
    expected[3]["new"] = [1, {"k": []}]
    expected[4]["lines"][1]["tags"] = ["first"]
    expected[5]["meta"] = {}
    expected[6]["lines"][0]["tags"] = ["only"]
    assert {k: r.json for k, r in got.items()} == {k: plain(v) for k, v in expected.items()} and all(r.issues == "" for r in got.values())
    after = spark.createDataFrame([(k, r.json) for k, r in got.items() if k != 1], "doc long, json string")  # what followed a removed place has moved up
    back = {r.doc: r for r in revisions.revised(after, revisions.reversed_patches(patches.filter("doc <> 1")), BY).collect()}
    original = revisions.revised(documents, patches.limit(0), BY).filter("doc = 9").first().digest
    assert {r.digest for r in back.values()} == {original}


def test_conflicts_are_told_and_change_nothing(spark, documents):
    rows = [(0, 1, "$.title", "two", "three"), (1, 1, "$.lines", DOC["lines"], []), (1, 2, "$.lines[0].n", 1, 5), (2, 1, "$.nothing", 1, 2), (3, 1, "$.title", ..., "new"), (4, 1, "$.title", "one", "one"), (5, 1, "$.title", "one", "a"), (5, 2, "$.title", "one", "b"), (6, 1, "$.title", "one", "kept out"), (6, 2, "$.meta.by", 1, 2)]
    patches = patch(spark, rows).unionByName(spark.createDataFrame([(7, 1, "$.title", '"one"', "no json")], "doc long, number long, path string, before string, after string"))
    got = {r.doc: r for r in revisions.revised(documents, patches, BY).collect()}
    assert {k: r.issues for k, r in got.items() if r.issues} == {0: "stale", 1: "overlap", 2: "missing", 3: "exists", 4: "no_change", 5: "overlap", 6: "stale", 7: "invalid_json"}
    assert {r.json for r in got.values()} == {plain(DOC)}


def test_paths_as_written(spark):
    df = spark.createDataFrame([("$.lines[12].note",), ("$",), ("$[0][1]",)], "p string")
    got = [tuple(r) for r in df.select(revisions.steps(F.col("p")), revisions.written(revisions.steps(F.col("p")))).collect()]
    assert got == [([".lines", "[0000000012]", ".note"], "$.lines[12].note"), ([], "$"), (["[0000000000]", "[0000000001]"], "$[0][1]")]
