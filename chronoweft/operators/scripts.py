"""What a brief asks for and how well a passage answers it; repeats within a passage; clock drift by consensus."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words and characters of a brief that say nothing about its subject, and fillers of speech.
BRIEF_STOPWORDS = ("about", "after", "again", "all", "also", "and", "any", "are", "but", "can", "clip", "clips", "find", "for", "from", "get", "has", "have", "into", "moment", "moments", "more", "most", "not", "one", "out", "show", "that", "the", "this", "video", "want", "when", "where", "with", "your")
BRIEF_STOP_CHARS = "的一是在不了有和就都而及与或把被给这那我你他她它们个很太也要想找从到"
FILLERS = {"zh": ("嗯", "呃", "啊", "那个", "就是", "然后", "其实就是", "怎么说"), "en": ("um", "uh", "like", "you know", "i mean", "sort of", "kind of")}
MOST_TERMS = 24
# The share of coverage, frequency and early matches in how a brief is answered; the penalty of a filler and of all.
COVERAGE, FREQUENCY, EARLY = 0.72, 0.18, 0.10
FILLER, ALL_FILLERS = 0.035, 0.18
#: Probes that a drift needs at least.
LEAST_INLIERS = 4


def brief_terms(brief: Column) -> Column:
    """Terms of a brief in order: quoted phrases, words of three letters or more, and Chinese runs with their parts of four, three and two characters; at most MOST_TERMS."""
    quoted = F.regexp_extract_all(brief, F.lit("[\"'“”‘’](.*?)[\"'“”‘’]"), F.lit(1))
    words = F.transform(F.regexp_extract_all(F.lower(brief), F.lit("[a-z0-9][a-z0-9'_-]*"), F.lit(0)), lambda w: F.regexp_replace(w, "^[_'-]+|[_'-]+$", ""))
    words = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*BRIEF_STOPWORDS))
    none = F.array().cast("array<string>")

    def parts(run: Column) -> Column:
        of = lambda n: F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substring(run, i, F.lit(n)))).otherwise(none)
        telling = F.filter(F.flatten(F.array(of(4), of(3), of(2))), lambda p: ~p.rlike(f"^[{BRIEF_STOP_CHARS}]+$"))
        return F.concat(F.when(F.length(run) <= 8, F.array(run)).otherwise(none), telling)

    chinese = F.flatten(F.transform(F.regexp_extract_all(brief, F.lit("[\\u4e00-\\u9fff]{2,}"), F.lit(0)), parts))
    clean = lambda t: F.regexp_replace(F.lower(F.trim(F.regexp_replace(t, r"\s+", " "))), "^[ ,.;:!?()\\[\\]{}\"'`]+|[ ,.;:!?()\\[\\]{}\"'`]+$", "")
    every = F.filter(F.transform(F.concat(quoted, words, chinese), clean), lambda t: F.length(t) >= 2)
    return F.slice(F.array_distinct(every), 1, MOST_TERMS)


def brief_match(text: Column, terms: Column) -> Column:
    """How well a text answers the terms of a brief: (matched, coverage, frequency, early, score), to 3 places; longer terms weigh more."""
    low = F.lower(text)
    weight = lambda t: 1 + F.least(F.lit(1.0), F.greatest(F.lit(0), F.length(t) - 2) / 5)
    total = lambda terms, value: F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + value(t))
    hit = F.filter(terms, lambda t: F.contains(low, t))
    times = total(hit, lambda t: (F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t))
    first = F.array_min(F.transform(hit, lambda t: F.expr("0") + F.position(t, low) - 1))
    coverage = F.coalesce(total(hit, weight) / F.nullif(total(terms, weight), F.lit(0.0)), F.lit(0.0))
    frequency = F.least(F.lit(1.0), times / F.greatest(F.lit(1.0), F.size(terms) * 0.5))
    early = F.coalesce(F.greatest(F.lit(0.0), 1 - first / F.greatest(F.lit(24), F.floor(F.length(low) * 0.35))), F.lit(0.0))
    score = F.least(F.lit(1.0), COVERAGE * coverage + FREQUENCY * frequency + EARLY * early)
    return F.struct(hit.alias("matched"), F.round(coverage, 3).alias("coverage"), F.round(frequency, 3).alias("frequency"), F.round(early, 3).alias("early"), F.round(score, 3).alias("score"))


def filler_penalty(text: Column, language: str) -> Column:
    """0.035 for each filler of the language that occurs, 0.18 at most."""
    low = F.lower(text)
    return F.least(F.lit(ALL_FILLERS), FILLER * sum((F.contains(low, F.lit(f)).cast("int") for f in FILLERS[language]), F.lit(0)))


def internal_repeats(tokens: Column, least: int, most: int) -> Column:
    """Runs of tokens that are said twice in a row, an array of (at, tokens): the longest of least to most at each place, and on after both."""
    none = F.array().cast("array<struct<at:int,tokens:array<string>>>")
    sizes = F.sequence(F.lit(most), F.lit(least), F.lit(-1))

    def step(acc: Column, i: Column) -> Column:
        twice = lambda k: (i + 2 * k <= F.size(tokens)) & (F.slice(tokens, i + 1, k) == F.slice(tokens, i + 1 + k, k))
        found = F.try_element_at(F.filter(sizes, twice), F.lit(1))
        hit = F.array(F.struct(i.alias("at"), F.slice(tokens, i + 1, found).alias("tokens")))
        return F.when((i < acc["free"]) | found.isNull(), acc).otherwise(F.struct(F.concat(acc["out"], hit).alias("out"), (i + 2 * found).alias("free")))

    start = F.struct(none.alias("out"), F.lit(0).alias("free"))
    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda acc: acc["out"])


#: First probes of lines that are taken at once, and distances that are held at once.
_FIRSTS, _HELD = 64, 1 << 21
#: From so many probes on lines are first told apart by bounds of how many probes they have.
_MANY = 256


def _spread_counts(t: np.ndarray, y: np.ndarray, a: int, s: np.ndarray, residual: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most probes that can be within residual of the lines through probe a with slopes s: every other probe is near for an interval of slopes, give or take what doubles lose."""
    dt, dy = t - t[a], y - y[a]
    other = dt != 0
    ends = np.stack([(dy[other] - residual) / dt[other], (dy[other] + residual) / dt[other]])
    low, high = np.sort(ends.min(0)), np.sort(ends.max(0))
    lost = 64 * np.finfo(float).eps * (np.abs(y).max() + residual + np.abs(s) * np.abs(t).max())
    give = lost / np.abs(dt[other]).min()
    same = np.sort(np.abs(dy[~other]))
    least = np.searchsorted(low, s - give, "left") - np.searchsorted(high, s + give, "right") + np.searchsorted(same, residual - lost, "left")
    most = np.searchsorted(low, s + give, "right") - np.searchsorted(high, s - give, "left") + np.searchsorted(same, residual + lost, "right")
    return least, most


def _best_lines(first: int, t: np.ndarray, y: np.ndarray, residual: float) -> np.ndarray:
    """Rows lat, rat, s, i, n, m of the lines with most probes within residual, and of these with the least median (to two of the ninth place), among those that begin at the _FIRSTS times from the first-th on. t is sorted."""
    times, where = np.unique(t, return_index=True)
    where = np.append(where, len(t))
    begin, end = where[first], where[min(first + _FIRSTS, len(times))]
    a, b = np.nonzero(t[begin:end, None] < t[None, :])
    a += begin
    s = (y[b] - y[a]) / (t[b] - t[a])
    i = y[a] - s * t[a]
    copies = np.ones(len(a), dtype=np.int64)
    if len(times) < len(t):  # the same line through the same times, from probes that lie together
        _, one, copies = np.unique(np.stack([t[a], t[b], s, i]), axis=1, return_index=True, return_counts=True)
        order = np.argsort(one)
        one, copies = one[order], copies[order]
        a, b, s, i = a[one], b[one], s[one], i[one]
    if len(t) >= _MANY and len(a) and np.isfinite(t).all() and np.isfinite(y).all() and np.isfinite(s).all():
        cuts = np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a))
        least, most = (np.concatenate(x) for x in zip(*(_spread_counts(t, y, a[u], s[u:v], residual) for u, v in zip(cuts[:-1], cuts[1:], strict=True)), strict=True))
        likely = most * copies >= (least * copies).max()
        a, b, s, i, copies = a[likely], b[likely], s[likely], i[likely], copies[likely]

    def parts(chosen: np.ndarray):
        step = max(1, _HELD // len(t))
        for k in range(0, len(chosen), step):
            c = chosen[k : k + step]
            yield c, np.abs(y[None, :] - i[c, None] - s[c, None] * t[None, :])

    n = np.zeros(len(a), dtype=np.int64)
    for c, r in parts(np.arange(len(a))):
        n[c] = (r <= residual).sum(1) * copies[c]
    chosen = np.flatnonzero((n > 0) & (n == n.max(initial=0)))
    m = np.zeros(len(a))
    for c, r in parts(chosen):
        near = np.sort(np.where(r <= residual, r, np.inf), axis=1)
        inside, row = n[c] // copies[c], np.arange(len(c))
        m[c] = (near[row, (inside - 1) // 2] + near[row, inside // 2]) / 2
    chosen = chosen[m[chosen] <= m[chosen].min(initial=np.inf) + 2e-9]
    return np.stack([t[a], t[b], s, i, n, m])[:, chosen]


def _consensus_lines(residual: float):
    names = ["lat", "rat", "s", "i", "n", "m"]

    def lines(first: pd.Series, t: pd.Series, y: pd.Series) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            found = [_best_lines(k, np.asarray(u, dtype=float), np.asarray(v, dtype=float), residual) for k, u, v in zip(first, t, y, strict=True)]
        return pd.DataFrame({name: [f[k] for f in found] for k, name in enumerate(names)})

    return F.pandas_udf(lines, "struct<" + ",".join(f"{n}:array<double>" for n in names) + ">")


def drift_consensus(probes: DataFrame, by: Sequence[str], least_confidence: float, residual: float, least_span: float, most_ppm: float) -> DataFrame:
    """(by, slope, intercept, probes, inliers, span, worst, reasons): the clock drift of probes (by, at, offset, confidence) that most of them agree on.

    Each pair of probes is a line; the one with most probes within `residual` wins, of several the one with the smaller median residual, then
    the flatter one. Its inliers are fitted by least squares. reasons says why a drift isn't to be trusted. A row holds all probes of a key and the
    times where some of its lines begin, and gives the best of these; lines aren't joined with probes. From _MANY probes on, most lines are left out by bounds that a
    sort of slopes gives, so the work is near the square of a key's probes unless lines tie.
    """
    good = probes.filter((F.col("confidence") >= least_confidence) & F.col("at").isNotNull() & F.col("offset").isNotNull()).select(*by, "at", "offset")
    sorted_probes = F.array_sort(F.collect_list(F.struct(F.col("at").cast("double").alias("at"), F.col("offset").cast("double").alias("offset"))))
    packed = good.groupBy(*by).agg(sorted_probes.alias("p")).select(*by, F.col("p.at").alias("ats"), F.col("p.offset").alias("offsets"))
    begins = F.sequence(F.lit(0), F.size(F.array_distinct("ats")) - 1, F.lit(_FIRSTS))
    spread = packed.select(*by, "ats", "offsets", F.explode(begins).alias("first")).repartition(int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "first")
    lines = spread.select(*by, _consensus_lines(residual)("first", "ats", "offsets").alias("x"))
    each = lines.select(*by, F.inline(F.arrays_zip(*(F.col(f"x.{c}").alias(c) for c in ("lat", "rat", "s", "i", "n", "m")))))
    best = each.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), F.round("m", 9), F.round(F.abs("s"), 12), "lat", "rat"))).filter("k = 1").select(*by, "s", "i")
    inside = good.join(best, list(by)).filter(F.abs(F.col("offset") - F.col("i") - F.col("s") * F.col("at")) <= residual)
    fit = inside.groupBy(*by).agg(F.regr_slope("offset", "at").alias("slope"), F.regr_intercept("offset", "at").alias("intercept"), F.count("*").alias("inliers"), (F.max("at") - F.min("at")).alias("span"))
    worst = inside.join(fit, list(by)).groupBy(*by).agg(F.max(F.abs(F.col("offset") - F.col("slope") * F.col("at") - F.col("intercept"))).alias("worst"))
    counted = good.groupBy(*by).agg(F.count("*").alias("probes")).join(fit, list(by), "left").join(worst, list(by), "left")
    reasons = F.when(F.col("probes") < LEAST_INLIERS, "too_few_confident_probes").when(F.col("inliers").isNull(), "probe_times_not_distinct").when(F.col("inliers") < LEAST_INLIERS, "too_few_consensus_inliers").otherwise(
        F.concat_ws(",", F.when(F.col("span") < least_span, "probe_span_too_short"), F.when(F.col("worst") > residual, "fit_residual_too_large"), F.when(F.abs("slope") * 1e6 > most_ppm, "drift_rate_implausible"))
    )
    return counted.withColumn("reasons", reasons)
