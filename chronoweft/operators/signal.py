"""Signals sampled at fixed steps: best lag between two, and clock drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lag_scores(a: DataFrame, b: DataFrame, by: Sequence[str], most_lag: int, frame: str = "frame", value: str = "value") -> DataFrame:
    """(by, lag, score): normalised correlation of a[frame] with b[frame + lag] for each lag from -most_lag to most_lag."""
    energy = lambda df, name: df.groupBy(*by).agg(F.sum(F.col(value) * F.col(value)).alias(name))
    shifted = b.select(*by, F.col(value).alias("__b"), F.col(frame).alias("__frame"), F.explode(F.sequence(F.lit(-most_lag), F.lit(most_lag))).alias("lag")).withColumn(frame, F.col("__frame") - F.col("lag"))
    products = a.join(shifted, [*by, frame]).groupBy(*by, "lag").agg(F.sum(F.col(value) * F.col("__b")).alias("product"))
    both = products.join(energy(a, "ea"), list(by)).join(energy(b, "eb"), list(by))
    return both.withColumn("score", F.col("product") / F.sqrt(F.col("ea") * F.col("eb"))).select(*by, "lag", "score")


def best_lag(scores: DataFrame, by: Sequence[str], apart: int = 2) -> DataFrame:
    """(by, lag, score, margin): the best lag, the smallest of equal ones by distance from 0 and then value, and how far it is above all lags more than `apart` away."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.abs("lag"), "lag")
    best = scores.withColumn("k", F.row_number().over(w)).filter("k = 1").select(*by, F.col("lag").alias("best"), F.col("score").alias("top"))
    other = scores.join(best, list(by)).groupBy(*by, "best", "top").agg(F.max(F.when(F.abs(F.col("lag") - F.col("best")) > apart, F.col("score"))).alias("next"))
    return other.select(*by, F.col("best").alias("lag"), F.col("top").alias("score"), (F.col("top") - F.coalesce("next", F.lit(0.0))).alias("margin"))


def drift(probes: DataFrame, by: Sequence[str], least_confidence: float, least_span: float, most_residual: float) -> DataFrame:
    """Clock drift of probes (by, at, offset, confidence) by least squares: slope, intercept, span, worst residual, and whether they may be trusted."""
    good = probes.filter(F.col("confidence") >= least_confidence)
    fit = good.groupBy(*by).agg(F.regr_slope("offset", "at").alias("slope"), F.regr_intercept("offset", "at").alias("intercept"), F.count("*").alias("n"), (F.max("at") - F.min("at")).alias("span"))
    worst = good.join(fit, list(by)).groupBy(*by).agg(F.max(F.abs(F.col("offset") - F.col("slope") * F.col("at") - F.col("intercept"))).alias("residual"))
    each = fit.join(worst, list(by))
    ok = (F.col("n") >= 4) & (F.col("span") >= least_span) & (F.col("residual") <= most_residual)
    return each.withColumn("status", F.when(F.col("n") < 4, "too_few").when(~ok, "untrusted").otherwise("fitted"))


def changes(rows: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], most: float) -> DataFrame:
    """Rows whose values differ from those of the row before by more than `most`, as a Euclidean distance."""
    w = Window.partitionBy(*by).orderBy(*order)
    squares = sum(((F.col(v) - F.lag(v).over(w)) * (F.col(v) - F.lag(v).over(w)) for v in values), F.lit(0.0))
    return rows.withColumn("jump", F.sqrt(squares)).filter(F.col("jump") > most)
