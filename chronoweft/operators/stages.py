"""Graphs of stages and of receipts: what a state means for all that depends on it, and which stages depend on themselves.

Rounds pass on only what changed in the round before, so the work is that of the edges that news travels over. Lineage is cut each round.

Cases: edges from or to ids that are no nodes are left out (missing_ends tells them); repeated edges and loops count once; nodes without edges keep their own
state. Repeated node rows: the worst state counts. No nodes, no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft.operators.graph import cut_lineage


def _rank(status: Column, worst_last: Sequence[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, worst_last)), status)


def missing_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(up, down, missing): edges whose ends are no nodes."""
    known = nodes.select("id").distinct()
    ends = edges.select("up", "down", F.explode(F.array("up", "down")).alias("missing")).distinct()
    return ends.join(known.withColumnRenamed("id", "missing"), "missing", "left_anti").select("up", "down", "missing")


def propagated(nodes: DataFrame, edges: DataFrame, worst_last: Sequence[str] = ("ready", "warn", "blocked")) -> DataFrame:
    """(id, status, effective, cause): of nodes (id, status) the worst state among themselves and all they depend on by edges (up, down), and the smallest id that has it; a state outside worst_last counts as better than all."""
    own = nodes.groupBy("id").agg(F.max(F.coalesce(_rank(F.col("status"), worst_last), F.lit(0))).alias("own"))
    own = cut_lineage(own.withColumn("best", F.struct(F.col("own").alias("rank"), (-F.col("id")).alias("cause"))), "states")
    known = own.select("id")
    links = edges.select("up", "down").distinct().join(known.withColumnRenamed("id", "up"), "up", "semi").join(known.withColumnRenamed("id", "down"), "down", "semi")
    links = cut_lineage(links.filter("up <> down"), "links")
    state, news = own, own.select("id", "best")
    while True:
        heard = links.join(news.withColumnRenamed("id", "up"), "up").groupBy(F.col("down").alias("id")).agg(F.max("best").alias("heard"))
        state = cut_lineage(state.join(heard, "id", "left").select("id", "own", F.greatest("best", F.coalesce("heard", "best")).alias("best"), F.coalesce(F.col("heard") > F.col("best"), F.lit(False)).alias("new")), "states")
        news = state.filter("new").select("id", "best")
        state = state.drop("new")
        if news.isEmpty():
            break
    name = lambda rank: F.get(F.array(*map(F.lit, worst_last)), (rank - 1).cast("int"))
    return state.select("id", name(F.col("own")).alias("status"), name(F.col("best.rank")).alias("effective"), (-F.col("best.cause")).alias("cause"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges that are left when those into nodes that lead nowhere, and out of nodes that nothing leads to, go again and again."""
    rows, left = edges, edges.count()
    while left:
        both = rows.join(rows.select(F.col("down").alias("up")).distinct(), "up", "semi").join(rows.select(F.col("up").alias("down")).distinct(), "down", "semi")
        rows = cut_lineage(both.select("up", "down"), "core")
        before, left = left, rows.count()
        if left == before:
            break
    return rows


def _spread(state: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, color): the largest color that reaches an id along edges (a, b), its own included."""
    state = cut_lineage(state, "colors")
    news = state
    while True:
        heard = edges.join(news.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.max("color").alias("heard"))
        state = cut_lineage(state.join(heard, "id", "left").select("id", F.greatest("color", F.coalesce("heard", "color")).alias("color"), F.coalesce(F.col("heard") > F.col("color"), F.lit(False)).alias("new")), "colors")
        news = state.filter("new").select("id", "color")
        state = state.select("id", "color")
        if news.isEmpty():
            return state


def cycles(edges: DataFrame) -> DataFrame:
    """(id, cycle): ids that depend on themselves by edges (up, down), with the largest id of those that depend on each other.

    After trimming, the largest id that reaches each node is its color; from the nodes that are their own color, what reaches back within the color is one
    cycle. What is left is trimmed and colored again.
    """
    links = cut_lineage(edges.select("up", "down").filter("up IS NOT NULL AND down IS NOT NULL").distinct(), "links")
    found = links.filter("up = down").select(F.col("up").alias("id"), F.col("up").alias("cycle"))
    core = _trimmed(links.filter("up <> down"))
    while not core.isEmpty():
        ends = core.select(F.explode(F.array("up", "down")).alias("id")).distinct()
        color = _spread(ends.withColumn("color", F.col("id")), core.select(F.col("up").alias("a"), F.col("down").alias("b")))
        of = lambda end, name: color.select(F.col("id").alias(end), F.col("color").alias(name))
        alike = cut_lineage(core.join(of("up", "c"), "up").join(of("down", "d"), "down").filter("c = d").select("up", "down"), "alike")
        # Backwards from each color's own node; a mark of 1 beats 0.
        back = _spread(color.select("id", (F.col("id") == F.col("color")).cast("int").alias("color")), alike.select(F.col("down").alias("a"), F.col("up").alias("b"))).filter("color = 1")
        whole = cut_lineage(back.select("id").join(color, "id").select("id", F.col("color").alias("cycle")), "cycles")
        found = found.unionByName(whole)
        gone = whole.select("id")
        core = _trimmed(core.join(gone.withColumnRenamed("id", "up"), "up", "left_anti").join(gone.withColumnRenamed("id", "down"), "down", "left_anti"))
    # A node alone in its color is on no cycle unless it leads to itself.
    sizes = found.groupBy("cycle").agg(F.count_distinct("id").alias("n"))
    alone = links.filter("up = down").select(F.col("up").alias("id")).withColumn("loop", F.lit(True))
    rows = found.join(sizes, "cycle").join(alone, "id", "left").filter("n > 1 OR loop")
    return rows.groupBy("id").agg(F.max("cycle").alias("cycle"))


def manifest(nodes: DataFrame, edges: DataFrame, worst_last: Sequence[str] = ("ready", "warn", "blocked")) -> DataFrame:
    """(id, status, effective, cause, cycle): propagated states, where a stage that depends on itself counts as the worst."""
    round_ = cycles(edges.join(nodes.select(F.col("id").alias("up")).distinct(), "up", "semi").join(nodes.select(F.col("id").alias("down")).distinct(), "down", "semi"))
    marked = nodes.join(round_, "id", "left")
    told = propagated(marked.withColumn("status", F.when(F.col("cycle").isNotNull(), worst_last[-1]).otherwise(F.col("status"))), edges, worst_last)
    own = nodes.groupBy("id").agg(F.max_by("status", F.coalesce(_rank(F.col("status"), worst_last), F.lit(0))).alias("status"))
    return told.drop("status").join(own, "id").join(round_, "id", "left").select("id", "status", "effective", "cause", "cycle")


def receipts(documents: DataFrame, citations: DataFrame) -> DataFrame:
    """(id, state, rests_on, broken): documents (id, digest) that cite others by digest (citations: id, cites, digest).

    state is `broken` if a document it cites is missing or has another digest, `tainted` if one that it rests on, however far, is broken, else `sound`; rests_on is the smallest
    broken id that it rests on, broken the number of its own citations that don't hold. So a changed document taints exactly what cites it and what rests on that.
    """
    known = documents.groupBy(F.col("id").alias("cites")).agg(F.collect_set("digest").alias("__held"))
    links = citations.join(known, "cites", "left").withColumn("holds", F.coalesce(F.array_contains("__held", F.col("digest")), F.lit(False)))
    own = links.groupBy("id").agg(F.count_if(~F.col("holds")).alias("broken"))
    nodes = documents.select("id").distinct().join(own, "id", "left").fillna(0, ["broken"])
    told = propagated(nodes.select("id", F.when(F.col("broken") > 0, "blocked").otherwise("ready").alias("status")), citations.select(F.col("cites").alias("up"), F.col("id").alias("down")), ("ready", "blocked"))
    state = F.when(F.col("broken") > 0, "broken").when(F.col("effective") == "blocked", "tainted").otherwise("sound")
    return nodes.join(told, "id").select("id", state.alias("state"), F.when(F.col("effective") == "blocked", F.col("cause")).alias("rests_on"), "broken")
