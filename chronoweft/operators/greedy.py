"""Order-dependent choices: what is taken depends on what was taken before.

Each timeline's rows are folded in order with aggregate() over a sorted array, or, where the state is more than the rows taken, in a
grouped pandas function. Where a choice only concerns rows that meet, a timeline is first cut into stretches that no row spans (see
scans.in_stretches), so that a hot one runs in many tasks; elsewhere a timeline is one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.operators.graph import cut_lineage
from chronoweft.operators.scans import in_stretches

#: Candidates of a timeline that emphasis chooses from without cutting it.
WHOLE = 10_000


def cooldown(df: DataFrame, by: Sequence[str], at: str, least_gap: float, order: Sequence[str] = (), most: int | None = None, after_end: str | None = None) -> DataFrame:
    """The rows of each key, in order of at, whose at is least_gap or more after the last row taken (after its end, if after_end names that column); `most` of them."""
    rest = [c for c in df.columns if c not in by and c != at and c not in order]
    item = F.struct(at, *order, *rest)
    rows = df.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("__rows"))
    kind = df.select(item.alias("x")).schema["x"].dataType
    empty = F.array().cast(f"array<{kind.simpleString()}>")
    last = after_end or at
    far = lambda acc, x: (F.size(acc) == 0) | (x[at] - F.try_element_at(acc, F.lit(-1))[last] >= least_gap)
    room = (lambda acc: F.size(acc) < most) if most is not None else (lambda acc: F.lit(True))
    kept = F.aggregate("__rows", empty, lambda acc, x: F.when(far(acc, x) & room(acc), F.concat(acc, F.array(x))).otherwise(acc))
    return rows.select(*by, F.inline(kept))


def spaced(points: DataFrame, lengths: DataFrame, by: Sequence[str], least: float, at: str = "at", length: str = "duration") -> DataFrame:
    """Points of each timeline at least `least` after 0 and after each other; a last one that is closer to the end goes."""
    rows = points.join(lengths, list(by)).filter((F.col(at) > 0) & (F.col(at) < F.col(length))).groupBy(*by, length).agg(F.sort_array(F.collect_list(at)).alias("__points"))
    number = points.schema[at].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{number}>").alias("kept"), F.lit(0).cast(number).alias("last"))
    step = lambda acc, x: F.when(x - acc["last"] >= least, F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), x.alias("last"))).otherwise(acc)
    kept = rows.withColumn("__kept", F.aggregate("__points", start, step)["kept"])
    cut = F.when((F.size("__kept") > 0) & (F.col(length) - F.try_element_at("__kept", F.lit(-1)) < least), F.slice("__kept", 1, F.size("__kept") - 1)).otherwise(F.col("__kept"))
    return kept.select(*by, F.explode(cut).alias(at))


def _chosen(rows: DataFrame, keys: Sequence[str], order: Sequence[str], free: Callable[[Column, Column], Column]) -> DataFrame:
    """The rows of each key, by falling score and then order, for which free(those taken before, row) holds; rows without a score come last."""
    rest = [c for c in rows.columns if c not in [*keys, "score", *order]]
    score = F.col("score")
    unknown = score.isNull() | F.isnan(score.cast("double"))
    item = F.struct(unknown.alias("__unknown"), F.when(~unknown, -score).alias("__less"), *order, "score", *rest)
    kind = rows.select(item.alias("x")).schema["x"].dataType
    lists = rows.groupBy(*keys).agg(F.collect_list(item).alias("__rows"))
    # Most keys have one row, which is taken as it is.
    kept = F.aggregate(F.sort_array("__rows"), F.array().cast(f"array<{kind.simpleString()}>"), lambda acc, x: F.when(F.coalesce(free(acc, x), F.lit(True)), F.concat(acc, F.array(x))).otherwise(acc))
    return lists.select(*keys, F.inline(F.when(F.size("__rows") == 1, F.col("__rows")).otherwise(kept))).select(*rows.columns)


def suppressed(candidates: DataFrame, by: Sequence[str], most_overlap: float = 0.5) -> DataFrame:
    """Non-maximum suppression of candidates (by, id, start, end, score): by falling score, then start and id, those that no taken one overlaps by more than most_overlap of the shorter.

    Candidates of different stretches don't overlap, so each stretch is chosen from on its own.
    """

    overlap = lambda k, x: F.greatest(F.lit(0), F.least(k["end"], x["end"]) - F.greatest(k["start"], x["start"]))
    shorter = lambda k, x: F.greatest(F.least(k["end"] - k["start"], x["end"] - x["start"]).cast("double"), F.lit(1e-9))
    meets = lambda k, x: overlap(k, x) > most_overlap * shorter(k, x)
    each = lambda rows, keys: _chosen(rows, keys, ["start", "id"], lambda acc, x: ~F.exists(acc, lambda k: meets(k, x)))
    return in_stretches(candidates, by, F.col("start"), F.col("end"), each).select(*candidates.columns)


def emphasis(candidates: DataFrame, by: Sequence[str], least_gap: float, most: int, whole: int = WHOLE) -> DataFrame:
    """Of candidates (by, id, at, score) by falling score, then at and id, those at least least_gap from every taken one; `most` of each key.

    Timelines of up to `whole` candidates are chosen from as they are. A longer one is cut into stretches, which are farther apart than least_gap; the first `most` of all that these take are those of one pass over it.
    """

    free = lambda acc, x: (F.size(acc) < most) & ~F.exists(acc, lambda k: F.abs(k["at"] - x["at"]) < least_gap)
    each = lambda rows, keys: _chosen(rows, keys, ["at", "id"], free)
    long = candidates.groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") > whole).drop("__n")
    if long.isEmpty():
        return each(candidates, list(by)).select(*candidates.columns)
    of_long = [F.col(f"c.{k}").eqNullSafe(F.col(f"l.{k}")) for k in by]
    hot = lambda kind: candidates.alias("c").join(long.alias("l"), of_long, kind).select("c.*")
    taken = in_stretches(hot("left_semi"), by, F.col("at"), F.col("at") + least_gap, each)
    unknown = F.col("score").isNull() | F.isnan(F.col("score").cast("double"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(unknown, F.desc("score"), "at", "id"))
    first = taken.withColumn("__place", place).filter(F.col("__place") <= most).select(*candidates.columns)
    return each(hot("left_anti"), list(by)).select(*candidates.columns).unionByName(first)


def packed(units: DataFrame, by: Sequence[str], order: Sequence[str], size: Column, most: int, breaks: Column | None = None) -> DataFrame:
    """units with `pack`: neighbours together as long as their sizes sum to most; a unit for which breaks holds, or that is too large, begins a new one."""
    rest = [c for c in units.columns if c not in by and c not in order]
    rows = units.withColumn("__size", size).withColumn("__break", F.coalesce(breaks if breaks is not None else F.lit(False), F.lit(False)))
    item = F.struct(*order, "__size", "__break", *rest)
    arrays = rows.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("__rows"))
    start = F.struct(F.array().cast("array<int>").alias("packs"), F.lit(0).alias("pack"), F.lit(0).cast("double").alias("held"))
    full = lambda acc, x: x["__break"] | (acc["held"] + x["__size"] > most)

    def step(acc: Column, x: Column) -> Column:
        new = full(acc, x) & (acc["held"] > 0)
        number = acc["pack"] + F.when(new, 1).otherwise(0)
        return F.struct(F.concat(acc["packs"], F.array(number)).alias("packs"), number.alias("pack"), (F.when(new, 0.0).otherwise(acc["held"]) + x["__size"]).alias("held"))

    numbered = arrays.withColumn("__packs", F.aggregate("__rows", start, step)["packs"])
    both = numbered.select(*by, F.inline(F.arrays_zip(F.col("__rows").alias("row"), F.col("__packs").alias("pack"))))
    return both.select(*by, *(F.col(f"row.{c}").alias(c) for c in [*order, *rest]), "pack")


def windows(segments: DataFrame, by: Sequence[str], least: float, most: float, order: str = "start") -> DataFrame:
    """All runs of neighbouring segments (by, start, end) that last from least to most: (by, first, last, start, end)."""
    numbered = segments.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(order, "end")))
    a = numbered.select(*by, F.col("k").alias("first"), F.col("start"))
    stretch = lambda c: F.floor(c / most)
    b = numbered.select(*by, F.col("k").alias("last"), F.col("start").alias("__s"), F.col("end"), F.explode(F.array(stretch(F.col("start")), stretch(F.col("start")) - 1)).alias("__stretch"))
    pairs = a.withColumn("__stretch", stretch(F.col("start"))).join(b, [*by, "__stretch"])
    span = F.col("end") - F.col("start")
    return pairs.filter((F.col("last") >= F.col("first")) & (span >= least) & (span <= most)).select(*by, "first", "last", "start", "end")


def scan(df: DataFrame, by: Sequence[str], order: Sequence[str], step: Callable[[dict, object], object], schema: str) -> DataFrame:
    """Any other scan: step(state, row) gets a state of each key, empty at first, and the rows in order; what it returns other than None is kept, as tuples of schema."""
    names = [p.split()[0].strip("`") for p in schema.split(",")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state: dict = {}
        found = [step(state, r) for r in rows.sort_values(list(order)).itertuples(index=False)]
        return pd.DataFrame([f for f in found if f is not None], columns=names)

    return df.groupBy(*by).applyInPandas(run, schema)


def phrases(units: DataFrame, by: Sequence[str], break_gap: float, most_chars: int) -> DataFrame:
    """units (by, id, start, end, speaker, text) in order of start, end and id with the phrase each is in: a new one begins after a gap of
    break_gap, with another speaker (unless the phrase has several already), or where the text would be longer than most_chars."""

    def step(state: dict, row: object) -> tuple:
        speakers, chars, end = state.get("speakers", set()), state.get("chars", 0), state.get("end")
        other = len(speakers) == 1 and row.speaker and row.speaker not in speakers
        if end is not None and (row.start - end >= break_gap or other or most_chars and chars + len(row.text or "") + 1 > most_chars):
            speakers, chars, state["phrase"] = set(), 0, state["phrase"] + 1
        state["speakers"] = speakers | ({row.speaker} if row.speaker else set())
        state["chars"] = chars + len(row.text or "") + (1 if chars else 0)
        state["end"] = row.end
        state.setdefault("phrase", 1)
        return (*(getattr(row, k) for k in by), row.id, state["phrase"])

    keys = ", ".join(f"{k} {units.schema[k].dataType.simpleString()}" for k in by)
    return scan(units, by, ["start", "end", "id"], step, f"{keys}, id {units.schema['id'].dataType.simpleString()}, phrase int")


def _iou(a: Sequence[float], b: Sequence[float]) -> float:
    both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda r: max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])
    return both / (area(a) + area(b) - both) if both > 0 else 0.0


def tracks(boxes: DataFrame, by: Sequence[str], diagonal: float, max_gap: float, least_iou: float, least_score: float = 0.42) -> DataFrame:
    """boxes (by, id, label, at, x1, y1, x2, y2) in order of at and id with the track of each.

    A box joins the track of its label that was seen at most max_gap before and fits best: overlap with its last box, plus 0.35 for a near centre
    and 0.15 for a like area. It begins a track where neither the overlap nor the score suffices. A label of a timeline is cut where it isn't seen for longer than max_gap, as no track goes on there; each stretch is a scan, and tracks
    are numbered through.
    """

    def step(state: dict, row: object) -> tuple:
        box = (row.x1, row.y1, row.x2, row.y2)
        centre = lambda r: ((r[0] + r[2]) / 2, (r[1] + r[3]) / 2)
        area = lambda r: max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])
        best, score = None, -1.0
        for number, (last_at, last) in state.items():
            if not -0.001 <= row.at - last_at <= max_gap:
                continue
            (ax, ay), (bx, by_) = centre(box), centre(last)
            near = max(0.0, 1 - ((ax - bx) ** 2 + (ay - by_) ** 2) ** 0.5 / max(diagonal * 0.18, 1.0))
            like = min(area(box), area(last)) / max(area(box), area(last), 1.0)
            got = _iou(box, last) + 0.35 * near + 0.15 * like
            if got > score:
                best, score = number, got
        if best is None or (_iou(box, state[best][1]) < least_iou and score < least_score):
            best = len(state) + 1
        state[best] = (row.at, box)
        return (*(getattr(row, k) for k in by), row.label, row.id, best)

    keys = "".join(f"{k} {boxes.schema[k].dataType.simpleString()}, " for k in by)
    schema = f"{keys}label {boxes.schema['label'].dataType.simpleString()}, id {boxes.schema['id'].dataType.simpleString()}, track int, stretch_no long"
    each = lambda rows, inside: scan(rows, inside, ["at", "id"], lambda state, row: (*step(state, row), row.stretch_no), schema)
    found = cut_lineage(in_stretches(boxes.select(*by, "label", "id", "at", "x1", "y1", "x2", "y2"), [*by, "label"], F.col("at"), F.col("at") + max_gap, each), "tracks")
    before = Window.partitionBy(*by, "label").orderBy("stretch_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = found.groupBy(*by, "label", "stretch_no").agg(F.max("track").alias("__tracks")).withColumn("__before", F.coalesce(F.sum("__tracks").over(before), F.lit(0))).drop("__tracks")
    return found.join(offsets, [*by, "label", "stretch_no"]).select(*by, "label", "id", (F.col("track") + F.col("__before")).cast("int").alias("track"))


def merged_boxes(boxes: DataFrame, by: Sequence[str], least_iou: float = 0.7) -> DataFrame:
    """(by, label, start, end, x1, y1, x2, y2, n): boxes with times, each merged into the first box of its label so far that it overlaps in time and by least_iou; that one grows.

    Boxes of different stretches of time never overlap, so each stretch is merged on its own.
    """
    names = ["start", "end", "x1", "y1", "x2", "y2"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []
        for r in rows.sort_values(["start", "end", "x1", "y1"]).itertuples(index=False):
            box = [r.start, r.end, r.x1, r.y1, r.x2, r.y2]
            into = next((k for k in kept if min(k[1], box[1]) > max(k[0], box[0]) and _iou(k[2:6], box[2:6]) >= least_iou), None)
            if into is None:
                kept.append([*box, 1])
            else:
                into[0], into[2], into[3] = (min(into[i], box[i]) for i in (0, 2, 3))
                into[1], into[4], into[5] = (max(into[i], box[i]) for i in (1, 4, 5))
                into[6] += 1
        out = pd.DataFrame(kept, columns=[*names, "n"])
        for k in [*by, "label"]:
            out[k] = rows[k].iloc[0]
        return out[[*by, "label", *names, "n"]]

    keys = ", ".join(f"{k} {boxes.schema[k].dataType.simpleString()}" for k in [*by, "label"])
    values = ", ".join(f"{n} {boxes.schema[n].dataType.simpleString()}" for n in names)
    each = lambda rows, inside: rows.groupBy(*inside).applyInPandas(run, f"{keys}, {values}, n long")
    return in_stretches(boxes, [*by, "label"], F.col("start"), F.col("end"), each)


def adjacent_repeats(segments: DataFrame, by: Sequence[str], threshold: float = 0.88, max_gap: float = 2500, least_chars: int = 6) -> DataFrame:
    """(by, id, keep, score): segments (by, id, start, end, normal) that repeat the last surviving one, or that are repeated by a later one that is at least 1.15 times as long, rounded down."""
    from difflib import SequenceMatcher

    def step(state: dict, row: object) -> tuple | None:
        before, state["last"] = state.get("last"), row
        if before is None or len(row.normal or "") < least_chars or len(before.normal or "") < least_chars or row.start - before.end > max_gap:
            return None
        a, b = before.normal, row.normal
        inside = min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else 0.0
        score = max(SequenceMatcher(None, a, b).ratio(), inside)
        if score < threshold:
            return None
        longer = len(b) >= int(1.15 * len(a))
        gone, kept = (before, row) if longer else (row, before)
        state["last"] = kept
        return (*(getattr(row, k) for k in by), gone.id, kept.id, score)

    keys = ", ".join(f"{k} {segments.schema[k].dataType.simpleString()}" for k in by)
    kind = segments.schema["id"].dataType.simpleString()
    return scan(segments, by, ["start", "end", "id"], step, f"{keys}, id {kind}, keep {kind}, score double")
