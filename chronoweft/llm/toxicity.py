"""Toxicity: a convolutional text classifier in numpy.

Words are looked up in hashed embeddings (the word and parts of it, see hashed_words), filters of several widths
run over the whole text, the maximum of each filter over all positions goes into one logistic unit. It is trained
by stochastic gradient descent with AdaGrad on a bounded, documented sample of labelled rows. Filters, output weights and embeddings
begin at random but for one dimension of the embeddings, the log-odds of a bucket among the labels, without which few labels teach too little. On rows kept back from the training sample a slope is fitted and scores are shifted so that 0.5 is the best
threshold of the text's language, as predicted from the text itself by language ID.

Cases: a null or empty text has no word and gets the score of an all-zero window. Rows with a null label or key teach
nothing, and of rows that share a key the one with the smallest text. Without rows of both classes every score is 0 (no evidence of toxicity).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import bounded_sample, fresh, map_batches, one_label, texts_of
from chronoweft.llm.hashed_words import BUCKETS, FEATURES, WordIndex, WordVectors
from chronoweft.llm.language_id import LanguageModel

#: Bound of the training sample: so many labelled rows of each class, about.
SAMPLE_PER_CLASS = 2500
#: Longer texts aren't trained on, so the sample has a bound in bytes; they are scored whole like all others.
MOST_CHARS = 50_000
WIDTHS = (1, 2, 3)
DIMENSIONS = 16
FILTERS = 12
#: Passes over the sample at least, and documents seen at least: few labels are seen more often.
EPOCHS = 8
LEAST_SEEN = 24_000
#: Deviation of the random embeddings, and bounds of the fitted slope.
_SPREAD = 0.1
_SLOPES = (0.25, 4.0)
_BATCH = 32
#: A language needs so many rows of each class for a threshold of its own.
_LEAST = 15


def _spans(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of texts laid one after another with at least one row and max(WIDTHS) - 1 empty rows after each: (starts, ends, all rows)."""
    held = np.maximum(sizes, 1)
    room = held + max(WIDTHS) - 1
    starts = np.concatenate([[0], np.cumsum(room)[:-1]])
    return starts, starts + held, np.array(room.sum())


def _laid_out(vectors: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, n = _spans(sizes)
    x = np.zeros((int(n) + max(WIDTHS), vectors.shape[1]), np.float32)
    x[np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(vectors))] = vectors
    return x, starts, ends


@dataclass
class ToxicityModel:
    """Empty until fit; then embeddings, filters by width and offset, output weights and thresholds."""

    languages: LanguageModel
    embeddings: np.ndarray | None = None
    filters: dict[int, np.ndarray] = field(default_factory=dict)
    out: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    threshold: dict[str, float] = field(default_factory=dict)
    default_threshold: float = 0.0

    def _convolved(self, x: np.ndarray, width: int) -> np.ndarray:
        n = len(x) - max(WIDTHS)
        return sum(x[k : k + n] @ self.filters[width][k] for k in range(width))

    def logits_of_vectors(self, vectors: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        x, starts, ends = _laid_out(vectors, sizes)
        cuts = np.stack([starts, ends], 1).ravel()
        pooled = [np.maximum.reduceat(np.vstack([c := self._convolved(x, w), c[-1:]]), cuts)[::2] for w in WIDTHS]
        return np.maximum(np.hstack(pooled), 0) @ self.out + self.bias

    def scores(self, texts: list[str], vectors: WordVectors) -> np.ndarray:
        if self.embeddings is None:
            return np.zeros(len(texts))
        z = self.logits_of_vectors(*vectors.rows_of(texts))
        langs, _ = self.languages.score(texts)
        cut = np.array([self.threshold.get(lang, self.default_threshold) for lang in langs])
        return 1 / (1 + np.exp(-np.clip(self.slope * (z - cut), -30, 30)))

    def train(self, texts: list[str], labels: np.ndarray, seed: int = 7) -> None:
        if not len(labels) or labels.min() == labels.max():
            return
        rng = np.random.default_rng(seed)
        index, docs = WordIndex(), []
        for s in range(0, len(texts), 256):  # in slices, as words weigh more than their buckets
            rows, sizes = index.look_up(texts[s : s + 256])
            feats = np.array(index.rows or [(0,) * FEATURES], np.int32)[rows]
            docs += [x.copy() for x in np.split(feats, np.cumsum(sizes)[:-1])]
        order = rng.permutation(len(texts))
        kept_back, train = order[: len(order) // 5], order[len(order) // 5 :]
        if labels[train].min() == labels[train].max():
            train = order
        self.embeddings = rng.normal(0, _SPREAD, (BUCKETS, DIMENSIONS)).astype(np.float32)
        docs_with = np.zeros((2, BUCKETS))
        for i in train:
            docs_with[labels[i], np.unique(docs[i])] += 1
        n = np.bincount(labels[train], minlength=2)
        odds = np.log((docs_with[1] + 4) / (n[1] + 8)) - np.log((docs_with[0] + 4) / (n[0] + 8))
        self.embeddings[:, 0] = odds / 2
        for w in WIDTHS:
            self.filters[w] = rng.normal(0, (w * DIMENSIONS) ** -0.5, (w, DIMENSIONS, FILTERS)).astype(np.float32)
        self.out = rng.normal(0, _SPREAD, FILTERS * len(WIDTHS)).astype(np.float32)
        positive = float(labels[train].mean())
        self.bias = float(np.log(positive / (1 - positive)))
        self._descend(docs, labels, train, rng)
        self._calibrate(texts, labels, kept_back if len(kept_back) >= 20 else order)

    def _descend(self, docs: list[np.ndarray], labels: np.ndarray, train: np.ndarray, rng: np.random.Generator) -> None:
        squares = {"e": np.full(BUCKETS, 1e-3), "o": np.full(len(self.out), 1e-3), "b": 1e-3} | {w: np.full(self.filters[w].shape, 1e-3) for w in WIDTHS}
        rate = 0.05
        for _ in range(max(EPOCHS, min(30, LEAST_SEEN // max(len(train), 1)))):
            for at in np.array_split(rng.permutation(train), max(1, len(train) // _BATCH)):
                sizes = np.array([len(docs[i]) for i in at])
                feats = np.concatenate([docs[i] for i in at]) if sizes.sum() else np.zeros((0, FEATURES), int)
                x, starts, ends = _laid_out(self.embeddings[feats].mean(1), sizes)
                where = np.full((len(x), FEATURES), -1)
                where[np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(feats))] = feats
                tops, pooled = [], []
                for w in WIDTHS:
                    c = self._convolved(x, w)
                    tops.append(np.stack([s + c[s:e].argmax(0) for s, e in zip(starts, ends, strict=True)]))
                    pooled.append(np.take_along_axis(c, tops[-1], 0))
                h = np.hstack(pooled)
                active = np.maximum(h, 0)
                p = 1 / (1 + np.exp(-np.clip(active @ self.out + self.bias, -30, 30)))
                g = ((p - labels[at]) / len(at)).astype(np.float32)
                g_h = g[:, None] * self.out * (h > 0)
                g_out = active.T @ g + 1e-4 * self.out
                rows, grads = [], []
                for k, w in enumerate(WIDTHS):
                    g_w = g_h[:, k * FILTERS : (k + 1) * FILTERS]
                    g_f = np.empty_like(self.filters[w])
                    for o in range(w):
                        seen = tops[k] + o
                        g_f[o] = np.einsum("bfd,bf->df", x[seen], g_w)
                        rows.append(where[seen].reshape(-1, FEATURES))
                        grads.append((g_w[:, :, None] * self.filters[w][o].T[None]).reshape(-1, DIMENSIONS) / FEATURES)
                    squares[w] += g_f**2
                    self.filters[w] -= rate * g_f / np.sqrt(squares[w])
                squares["o"] += g_out**2
                self.out -= rate * g_out / np.sqrt(squares["o"])
                squares["b"] += float(g.sum()) ** 2
                self.bias -= rate * float(g.sum()) / squares["b"] ** 0.5
                flat, grad = np.vstack(rows), np.vstack(grads)
                known = (flat[:, 0] >= 0) & (np.abs(grad).sum(1) > 0)
                flat, grad = flat[known].ravel(), np.repeat(grad[known], FEATURES, 0)
                touched, back = np.unique(flat, return_inverse=True)
                total = np.zeros((len(touched), DIMENSIONS), np.float32)
                np.add.at(total, back, grad)
                squares["e"][touched] += (total**2).mean(1)
                self.embeddings[touched] -= rate * total / np.sqrt(squares["e"][touched])[:, None]

    def _calibrate(self, texts: list[str], labels: np.ndarray, rows: np.ndarray) -> None:
        vectors = WordVectors(self.embeddings)
        own = [texts[i] for i in rows]
        z = np.concatenate([self.logits_of_vectors(*vectors.rows_of(own[s : s + 256])) for s in range(0, len(own), 256)])
        langs = np.array([x for s in range(0, len(own), 256) for x in self.languages.score(own[s : s + 256])[0]], object)
        y = labels[rows]
        self.default_threshold = _best_cut(z, y)
        for lang in sorted(set(langs)):
            of = langs == lang
            if min(y[of].sum(), (1 - y[of]).sum()) >= _LEAST:
                self.threshold[lang] = _best_cut(z[of], y[of])
        self.slope = _best_slope(z - np.array([self.threshold.get(lang, self.default_threshold) for lang in langs]), y)


def _best_slope(z: np.ndarray, y: np.ndarray) -> float:
    """The slope of the logistic curve through 0.5 at 0 that fits best, within bounds; by bisection, as the likelihood is concave."""
    low, high = _SLOPES
    for _ in range(40):
        mid = (low + high) / 2
        rising = (z * (y - 1 / (1 + np.exp(-np.clip(mid * z, -30, 30))))).sum() > 0
        low, high = (mid, high) if rising else (low, mid)
    return float((low + high) / 2)


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1, in the middle of the widest gap that has it; wrongly flagged rows count threefold."""
    order = np.argsort(z)[::-1]
    z, y = z[order], y[order]
    hits, wrong = np.cumsum(y), np.cumsum(1 - y) * 3
    f1 = 2 * hits / np.maximum(hits + wrong + y.sum(), 1)
    below = np.append(z[1:], z[-1] - 1)
    best = np.flatnonzero((f1 >= f1.max() - 1e-12) & (z > below))
    at = best[np.argmax((z - below)[best])] if len(best) else int(f1.argmax())
    return float((z[at] + below[at]) / 2)


def fit(docs: DataFrame, labels: DataFrame, languages: LanguageModel, text: str = "text", label: str = "toxic", key: str = "doc_id", sample_per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """Learns from docs (key, text) and labels (key, label of 0 or 1): a bounded sample of the labels (see SAMPLE_PER_CLASS), which is why it may be broadcast."""
    sample = bounded_sample(one_label(labels, label, key), "label", sample_per_class, "key", "toxicity")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter(F.length("text") <= MOST_CHARS)
    one = rows.join(F.broadcast(sample), "key").groupBy("key", "label").agg(F.min("text").alias("text"))
    got = one.toPandas().sort_values("key", kind="stable")
    model = ToxicityModel(languages)
    model.train(got["text"].tolist(), got["label"].to_numpy(np.int64))
    return model


def predict(df: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), score: str = "score") -> DataFrame:
    """The columns `keep` of df with the toxicity score of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    own = text if text in keep else "__text"
    rows = df.select(*keep) if text in keep else df.select(*keep, F.col(text).alias("__text"))

    def make():
        one = shared.value
        vectors = WordVectors(one.embeddings) if one.embeddings is not None else None

        def score_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(one.scores(texts_of(batch, own), vectors), pa.float64())], [*keep, score])

        return score_batch

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return map_batches(rows, make, f"{ddl}, `{score}` double", rows=256)


def keep_clean(df: DataFrame, model: ToxicityModel) -> DataFrame:
    """df without the documents that score 0.5 or more; the same columns."""
    score = fresh(df, "__score")
    return predict(df, model, keep=tuple(df.columns), score=score).filter(F.col(score) < 0.5).drop(score)
