"""Clock drift of recordings against a reference, measured in windows: a local offset in each, and the line that most of them agree on."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.functions import text as T
from chronoweft.operators import graph, inventory, scripts

# Probes that a measurement needs at least; shares of score and margin in a confidence; the margin that is full; lags that far from the best are others.
LEAST_PROBES = 5
SCORE, MARGIN, FULL_MARGIN, APART = 0.8, 0.2, 0.12, 2
#: Energy below which a window says nothing.
SILENT = 1e-9


def probe_cores(a: DataFrame, b: DataFrame, by: Sequence[str], base: int, probes: int, window: int, search: int, frame: str = "frame") -> DataFrame:
    """(by, probe, core): first frames in a of `probes` windows, evenly spread over what a and b share where b[frame] goes with a[frame + base]; none for a key that shares too little."""
    if probes < LEAST_PROBES or window <= 0 or search <= 0:
        raise ValueError(f"at least {LEAST_PROBES} probes, and a window and a search above 0")
    length = lambda df, name: df.groupBy(*by).agg((F.max(frame) + 1).alias(name))
    first = F.lit(max(search, base + search)).cast("long")
    last = F.least(F.col("__a") - window - search, F.col("__b") + base - window - search)
    room = length(a, "__a").join(length(b, "__b"), list(by)).select(*by, first.alias("__first"), last.alias("__last")).filter("__last >= __first")
    each = room.withColumn("probe", F.explode(F.sequence(F.lit(0), F.lit(probes - 1))))
    return each.select(*by, "probe", (F.col("__first") + F.floor((F.col("__last") - F.col("__first")) * F.col("probe") / (probes - 1))).alias("core"))


def _windows(a: DataFrame, b: DataFrame, cores: DataFrame, by: Sequence[str], base: int, size: int, search: int, frame: str, value: str) -> DataFrame:
    """cores with __a and __b: the `size` values of each side's window by place. A frame without a row is silent; of several rows of a frame the smallest value counts.

    Rows are gathered in chunks of `size` frames, of which a window meets two, so a window is joined with two lists and not with each of its frames.
    """
    chunk = lambda c: F.floor(c / size)
    of = lambda df, side: df.select(*by, F.lit(side).alias("__side"), F.col(frame).cast("long").alias("__frame"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("__value"))
    item = F.struct("__frame", "__value")
    chunks = of(a, 0).unionByName(of(b, 1)).groupBy(*by, "__side", chunk(F.col("__frame")).alias("__chunk")).agg(F.collect_list(item).alias("__rows"))
    first = F.col("core") - search
    sides = cores.withColumn("__w", F.explode(F.array(F.struct(F.lit(0).alias("__side"), first.alias("__start")), F.struct(F.lit(1).alias("__side"), (first - base).alias("__start"))))).select(*by, "probe", "core", "__w.*")
    wanted = sides.withColumn("__chunk", F.explode(F.sequence(chunk(F.col("__start")), chunk(F.col("__start") + (size - 1)))))
    met = wanted.join(chunks, [*by, "__side", "__chunk"], "left").withColumn("__rows", F.filter("__rows", lambda x: x["__frame"].between(F.col("__start"), F.col("__start") + (size - 1))))

    def placed(rows: str, start: Column) -> Column:
        # A frame is looked up in the list of frames, which is as short as a window.
        each = lambda x: F.transform(F.sequence(start, start + (size - 1)), lambda f: F.coalesce(F.get(x["v"], (F.array_position(x["f"], f) - 1).cast("int")), F.lit(0.0)))
        return T.bound(F.struct(F.transform(F.array_sort(rows), lambda r: r["__frame"]).alias("f"), F.transform(F.array_sort(rows), lambda r: r["__value"]).alias("v")), each)

    of_side = lambda side: F.flatten(F.collect_list(F.when(F.col("__side") == side, F.col("__rows"))))
    gathered = met.groupBy(*by, "probe", "core").agg(of_side(0).alias("__in_a"), of_side(1).alias("__in_b"))
    return gathered.select(*by, "probe", "core", placed("__in_a", first).alias("__a"), placed("__in_b", first - base).alias("__b"))


def _lag_scores(left: np.ndarray, right: np.ndarray, search: int, window: int) -> np.ndarray:
    """Scores of each lag from -search to search (columns) of windows of values (rows); nan where there is none."""
    x, y = inventory.window_features(left), inventory.window_features(right)
    size, whole_x, whole_y = x.shape[1], (x * x).sum(axis=1), (y * y).sum(axis=1)
    out = np.full((len(x), 2 * search + 1), np.nan)
    for lag in range(-search, search + 1):
        overlap = size - abs(lag)
        if overlap < max(1, round(window / 2)):
            continue
        u, v = x[:, max(0, lag) : max(0, lag) + overlap], y[:, max(0, -lag) : max(0, -lag) + overlap]
        eu, ev = (u * u).sum(axis=1), (v * v).sum(axis=1)
        heard = (eu > SILENT) & (ev > SILENT)
        share = np.minimum(1.0, np.minimum(eu[heard] / whole_x[heard], ev[heard] / whole_y[heard]))
        out[heard, lag + search] = (u * v).sum(axis=1)[heard] / np.sqrt(eu[heard] * ev[heard]) * share
    return out


def window_scores(a: DataFrame, b: DataFrame, cores: DataFrame, by: Sequence[str], base: int, window: int, search: int, frame: str = "frame", value: str = "value") -> DataFrame:
    """(by, probe, core, lag, overlap, score): how well b's window goes with a's, moved by each lag from -search to search.

    The score is the correlation over the frames that overlap, by their own energy, times the smaller share of a window's energy that overlaps. Lags with less than half a
    window in common, or with silence in it, have no row. A window holds window + 2 * search frames, so what is gathered is bounded by the parameters, whatever a key holds.
    """
    size = window + 2 * search
    both = _windows(a, b, cores, by, base, size, search, frame, value)

    keys = [*by, "probe", "core"]

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                found = _lag_scores(np.stack(rows["__a"].tolist()), np.stack(rows["__b"].tolist()), search, window)
                place, lag = np.nonzero(~np.isnan(found))
                out = rows[keys].iloc[place].reset_index(drop=True)
                yield out.assign(lag=lag - search, overlap=size - np.abs(lag - search), score=found[place, lag])

    kinds = "".join(f"`{k}` {both.schema[k].dataType.simpleString()}, " for k in keys)
    return both.mapInPandas(scores, f"{kinds}lag int, overlap int, score double")


def probe_offsets(scores: DataFrame, by: Sequence[str], base: int, window: int, search: int, least_confidence: float, step: float) -> DataFrame:
    """(by, probe, at, offset, score, margin, confidence, status): the best lag of each probe, in seconds of `step` a frame.

    Of equal scores (to nine places) the lowest lag counts. The margin is that above the best lag further than APART away, without one above the second best, without that above -1.
    status is `accepted`, `search_boundary` (the best lag lies at the end of what was searched) or `low_confidence`.
    """
    unit = [*by, "probe"]
    ranked = scores.withColumn("__k", F.row_number().over(Window.partitionBy(*unit).orderBy(F.desc(F.round("score", 9)), "lag")))
    ranked = ranked.withColumn("__best", F.first("lag").over(Window.partitionBy(*unit).orderBy("__k")))
    best = ranked.groupBy(*unit).agg(
        F.first("core").alias("core"), F.first("__best").alias("lag"), F.max(F.when(F.col("__k") == 1, F.col("score"))).alias("score"),
        F.max(F.when(F.abs(F.col("lag") - F.col("__best")) > APART, F.col("score"))).alias("__far"), F.max(F.when(F.col("__k") == 2, F.col("score"))).alias("__second"),
    )
    unit_range = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    margin = F.col("score") - F.coalesce("__far", "__second", F.lit(-1.0))
    sure = best.withColumn("margin", margin).withColumn("confidence", unit_range(SCORE * unit_range(F.col("score")) + MARGIN * unit_range(F.col("margin") / FULL_MARGIN)))
    status = F.when(search - F.abs("lag") <= 1, "search_boundary").when(F.col("confidence") < least_confidence, "low_confidence").otherwise("accepted")
    return sure.select(*unit, ((F.col("core") + window / 2) * step).alias("at"), ((F.col("lag") + base) * step).alias("offset"), "score", "margin", "confidence", status.alias("status"))


def measured(keys: DataFrame, probes: DataFrame, by: Sequence[str], least_confidence: float, residual: float, least_span: float, most_ppm: float, threshold: float) -> DataFrame:
    """keys (by) with the drift that their accepted probes agree on (as scripts.drift_consensus has it), and a status.

    `unreliable` with reasons, else `correction_required` if the clocks part by more than `threshold` seconds over the span, else `stable`. Keys without probes are unreliable.
    The accepted probes are written first, as the consensus reads them five times.
    """
    accepted = graph.cut_lineage(probes.filter("status = 'accepted'").select(*by, "at", "offset", "confidence"), "probes")
    fit = scripts.drift_consensus(accepted, by, least_confidence, residual, least_span, most_ppm)
    every = keys.select(*by).distinct().join(fit, list(by), "left").fillna(0, ["probes"])
    reasons = F.coalesce("reasons", F.lit("too_few_confident_probes"))
    status = F.when(reasons != "", "unreliable").when(F.abs(F.col("slope") * F.col("span")) > threshold, "correction_required").otherwise("stable")
    return every.withColumn("reasons", reasons).withColumn("status", status)
