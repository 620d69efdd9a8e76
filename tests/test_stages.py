"""States through graphs against plain loops; cycles against reachability."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chronoweft.operators import stages

ORDER = ("ready", "warn", "blocked")


def reach(ids, edges):
    out = {i: set() for i in ids}
    for i in ids:
        todo = [i]
        while todo:
            for up, down in edges:
                if up == todo[0] and down not in out[i]:
                    out[i].add(down)
                    todo.append(down)
            todo.pop(0)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_manifest_like_plain(spark, seed):
    rng = random.Random(seed)
    ids = list(range(1, 26))
    status = {i: rng.choice(["ready"] * 6 + ["warn", "blocked", None, "odd"]) for i in ids}
    edges = {(rng.choice(ids), rng.choice(ids)) for _ in range(rng.choice([14, 26, 40]))}
    nodes = spark.createDataFrame([(i, s, "clash") for i, s in status.items()], "id long, status string, best string")
    links = spark.createDataFrame([*edges, *list(edges)[:3], (99, 1), (1, 98), (None, 1)], "up long, down long")
    to = reach(ids, edges)
    cycle = {i: max(j for j in to[i] | {i} if i in to[j] or j == i) for i in ids if i in to[i]}
    rank = lambda i: 3 if i in cycle else ORDER.index(status[i]) + 1 if status[i] in ORDER else 0
    got = {r.id: r for r in stages.manifest(nodes, links).collect()}
    assert set(got) == set(ids)
    for i in ids:
        above = [j for j in ids if i in to[j] or j == i]
        worst = max(map(rank, above))
        assert (got[i].effective, got[i].cause) == (ORDER[worst - 1] if worst else None, min(j for j in above if rank(j) == worst)), i
        assert got[i].cycle == cycle.get(i) and got[i].status == status[i]
    assert {(r.up, r.down, r.missing) for r in stages.missing_ends(nodes, links.filter("up IS NOT NULL")).collect()} == {(99, 1, 99), (1, 98, 98)}


def test_empty_graphs(spark):
    nodes, links = spark.createDataFrame([(1, "warn")], "id long, status string"), spark.createDataFrame([], "up long, down long")
    assert [(r.effective, r.cause, r.cycle) for r in stages.manifest(nodes, links).collect()] == [("warn", 1, None)]
    assert stages.manifest(nodes.limit(0), links).count() == 0 and stages.cycles(links).count() == 0


def test_long_chain_and_ring(spark):
    links = spark.range(30).select(F.col("id").alias("up"), (F.col("id") + 1).alias("down"))
    nodes = spark.range(31).select("id", F.when(F.col("id") == 4, "blocked").otherwise("ready").alias("status"))
    got = {r.id: r.effective for r in stages.propagated(nodes, links).collect()}
    assert {i for i, e in got.items() if e == "blocked"} == set(range(4, 31))
    ring = links.unionByName(spark.createDataFrame([(30, 10)], "up long, down long"))
    assert {r.id: r.cycle for r in stages.cycles(ring).collect()} == dict.fromkeys(range(10, 31), 30)


def test_a_tampered_leaf_taints_exactly_what_rests_on_it(spark):
    """1 rests on nothing, 2 and 3 cite 1, 4 cites 2 and 3, 5 cites 6, 7 cites what isn't there."""
    cites = [(2, 1), (3, 1), (4, 2), (4, 3), (5, 6), (7, 50)]
    citations = spark.createDataFrame([(i, c, f"d{c}") for i, c in cites], "id long, cites long, digest string")
    documents = lambda changed: spark.createDataFrame([(i, f"d{i}" + "!" * (i == changed)) for i in range(1, 8)], "id long, digest string")
    states = lambda changed: {r.id: (r.state, r.rests_on, r.broken) for r in stages.receipts(documents(changed), citations).collect()}
    sound = {i: ("sound", None, 0) for i in range(1, 7)} | {7: ("broken", 7, 1)}
    assert states(0) == sound
    assert states(1) == sound | {2: ("broken", 2, 1), 3: ("broken", 3, 1), 4: ("tainted", 2, 0)}
    assert states(6) == sound | {5: ("broken", 5, 1)}
