"""Quality classifier by co-training.

Two views of a document: its text (hashed words and text statistics) and its page metadata (source, language,
length). Each view has a logistic classifier. Over several rounds each classifier scores all unlabelled documents, in
Spark, and labels those that it is sure of; of these pseudo-labels a bounded number joins the training set of the other
one, dealt evenly over sources, so that rare sources have their share beside a hot one. The words of the documents are
hashed once, for all rounds. Both views are then calibrated on labelled rows kept back from training, and their calibrated log-odds are added, less the prior.

Cases: null text or metadata count as empty, a null length as the text's own; rows with a null label or key teach nothing, and
of rows that share a key the one with the smallest text.
Without labelled rows of both classes every score is 0.5 and every document is kept. Columns of the input other
than the named ones play no part, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.llm.common import bounded_sample, map_batches, materialize, one_label, texts_of
from chronoweft.llm.hashed_words import WordIndex

#: Bound of the training sample, about: labelled rows of each class.
SAMPLE_PER_CLASS = 1500
ROUNDS = 4
#: Share of the unlabelled rows at hand that a view labels in each round.
SHARE_PER_ROUND = 0.05
#: Of the documents that a view is sure of, so many of a source and class, and of a class, are learned from in each round at most.
MOST_PER_SOURCE = 25
MOST_PER_ROUND = 250
_SURE = 0.9
#: Longer texts aren't trained on, so the sample has a bound in bytes; they are scored whole like all others.
MOST_CHARS = 50_000
METADATA_BUCKETS = 1 << 10
#: Passes over a training set at least, and rows seen at least: few labels are seen more often.
EPOCHS = 6
LEAST_SEEN = 16_000
#: Rows of each class that a half of the rows kept back has at least; with fewer both halves are one.
_LEAST_EACH = 20
_WORD_BUCKETS = 1 << 15
_TABLE = 0x3000


@lru_cache(1)
def _kinds() -> np.ndarray:
    """By code point: 1 capital, 2 small letter, 3 digit, 4 white space, 5 other."""
    kind = np.full(_TABLE + 1, 5, np.uint8)
    for c in range(_TABLE):
        s = chr(c)
        kind[c] = 4 if s.isspace() else 3 if s.isdigit() else 1 if s.isupper() else 2 if s.isalpha() else 5
    return kind


def text_statistics(texts: list[str], rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text: shares of capitals, digits and symbols, mean word length, share of new words, share of words equal to the one before, log length, share of repeated lines."""
    codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[np.minimum(codes, _TABLE)]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    share = {k: np.add.reduceat((kind == k).astype(np.int64), starts) for k in (1, 2, 3, 5)}
    letters, chars = np.maximum(share[1] + share[2], 1), np.maximum([len(t) for t in texts], 1)
    words = np.maximum(sizes, 1)
    ends = np.cumsum(sizes)
    fresh = np.array([len(np.unique(rows[e - n : e])) for e, n in zip(ends, sizes, strict=True)])
    same = np.array([(rows[e - n + 1 : e] == rows[e - n : e - 1]).sum() if n > 1 else 0 for e, n in zip(ends, sizes, strict=True)])
    lines = [[x for x in t.split("\n") if x] for t in texts]
    again = np.array([1 - len(set(x)) / len(x) if x else 0.0 for x in lines])
    return np.stack([share[1] / letters, share[3] / chars, share[5] / chars, np.minimum((letters / words) / 10, 3), fresh / words, same / words, np.log1p(sizes) / 8, again], 1)


def metadata_features(sources: list, langs: list, lengths: list[int]) -> np.ndarray:
    """Three buckets of each page: its source, its language, its length to a power of two."""
    code = lambda what, v: zlib.crc32(f"{what}:{v}".encode()) % METADATA_BUCKETS
    return np.array([[code("s", s), code("l", x), code("n", int(n).bit_length())] for s, x, n in zip(sources, langs, lengths, strict=True)], np.int64).reshape(-1, 3)


def _logistic(x: list[np.ndarray], dense: np.ndarray, y: np.ndarray, weight: np.ndarray, buckets: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """AdaGrad on the mean of the bucket weights of a row and its dense features."""
    rng = np.random.default_rng(seed)
    w, s = np.zeros(buckets), np.full(buckets, 1e-2)
    d, sd = np.zeros(dense.shape[1]), np.full(dense.shape[1], 1e-2)
    b = 0.0
    for _ in range(max(EPOCHS, min(80, LEAST_SEEN // max(len(y), 1)))):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            sizes = np.array([max(len(x[i]), 1) for i in at])
            idx = np.concatenate([x[i] if len(x[i]) else np.zeros(1, int) for i in at])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            z = np.add.reduceat(w[idx], starts) / np.sqrt(sizes) + dense[at] @ d + b
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) * weight[at] / len(at)
            grad = np.bincount(idx, np.repeat(g / np.sqrt(sizes), sizes), buckets)
            touched = np.flatnonzero(grad)
            grad = grad[touched] + 1e-5 * w[touched]
            s[touched] += grad**2
            w[touched] -= 0.05 * grad / np.sqrt(s[touched])
            gd = dense[at].T @ g
            sd += gd**2
            d -= 0.1 * gd / np.sqrt(sd)
            b -= 0.2 * g.sum()
    return w, d, b


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn z into log-odds of y."""
    a, b, prior = 1.0, 0.0, np.log((y.sum() + 1) / ((1 - y).sum() + 1))
    a, b = 0.0, float(prior)
    scale = max(float(z.std()), 1e-9)
    u = (z - z.mean()) / scale
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        a -= 0.5 * (((p - y) * u).mean() + 1e-3 * a)
        b -= 0.5 * (p - y).mean()
    a = max(a, 0.0)
    return a / scale, b - a * float(z.mean()) / scale


@dataclass
class QualityModel:
    prior: float = 0.0
    fitted: bool = False
    text: tuple = ()
    meta: tuple = ()
    platt: dict[str, tuple[float, float]] = field(default_factory=dict)
    rounds: list[tuple[int, int]] = field(default_factory=list)  # pseudo-labels that each view gave, by round

    def _raw(self, view: tuple, buckets: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        w, d, b = view
        return np.array([w[x].sum() / np.sqrt(len(x)) if len(x) else 0.0 for x in buckets]) + dense @ d + b

    def score(self, words: list[np.ndarray], statistics: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, text view, metadata view): calibrated probabilities of good quality."""
        if not self.fitted:
            return (np.full(len(words), 0.5),) * 3
        zt = self.platt["text"][0] * self._raw(self.text, words, statistics) + self.platt["text"][1]
        zm = self.platt["meta"][0] * self._raw(self.meta, list(metadata), np.zeros((len(words), 1))) + self.platt["meta"][1]
        p = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p(zt + zm - self.prior), p(zt), p(zm)


#: From (views, calibrations, rows that each view has labelled) to (the new (row, label) that each view is sure of, features of these rows).
Search = Callable[[dict[str, tuple], dict[str, tuple[float, float]], dict[str, set[int]]], tuple[dict[str, list[tuple[int, int]]], dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]]


def co_train(words: list[np.ndarray], statistics: np.ndarray, metadata: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, share: float = SHARE_PER_ROUND, seed: int = 5, search: Search | None = None) -> QualityModel:
    """labels: 0, 1, or -1 for an unlabelled row. Pseudo-labels are looked for among the unlabelled rows, or by search, if given."""
    model = QualityModel()
    known = np.flatnonzero(labels >= 0)
    if len(known) < 2 or labels[known].min() == labels[known].max():
        return model
    rng = np.random.default_rng(seed)
    known = rng.permutation(known)
    back, train = known[: len(known) // 5], known[len(known) // 5 :]
    if not len(back) or labels[train].min() == labels[train].max() or labels[back].min() == labels[back].max():
        back = train = known
    # One half of the rows kept back says how sure a view is in each round, the other calibrates the result.
    choose, final = back[: len(back) // 2], back[len(back) // 2 :]
    if min(np.bincount(labels[part], minlength=2).min() for part in (choose, final)) < _LEAST_EACH:
        choose = final = back
    pool = np.flatnonzero(labels < 0)
    own = {"text": dict.fromkeys(train.tolist()), "meta": dict.fromkeys(train.tolist())}
    for view in own:
        own[view] = {i: int(labels[i]) for i in train.tolist()}
    none = np.zeros((len(labels), 1))
    place: dict[int, int] = {}
    taken: dict[str, set[int]] = {"text": set(), "meta": set()}

    def calibrated(view: str, rows: np.ndarray) -> tuple[float, float]:
        z = model._raw(model.text, [words[i] for i in rows], statistics[rows]) if view == "text" else model._raw(model.meta, list(metadata[rows]), none[rows])
        return _platt(z, labels[rows])

    def fit(view: str) -> tuple:
        rows = np.array(list(own[view]))
        y = np.array([own[view][i] for i in rows.tolist()])
        weight = np.where(labels[rows] >= 0, 1.0, 0.5) * np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        if view == "text":
            return _logistic([words[i] for i in rows], statistics[rows], y, weight, _WORD_BUCKETS)
        return _logistic(list(metadata[rows]), none[rows], y, weight, METADATA_BUCKETS)

    model.text, model.meta = fit("text"), fit("meta")
    for _ in range(rounds):
        given = []
        if search:
            found, features = search({"text": model.text, "meta": model.meta}, {v: calibrated(v, choose) for v in own}, taken)
            new = [r for r in sorted(features) if r not in place]
            if new:
                place.update({r: len(labels) + k for k, r in enumerate(new)})
                words = [*words, *(features[r][0] for r in new)]
                statistics, metadata = np.vstack([statistics, *(features[r][1] for r in new)]), np.vstack([metadata, *(features[r][2] for r in new)])
                labels = np.concatenate([labels, np.full(len(new), -1)])
                none = np.zeros((len(labels), 1))
            for view, other in (("text", "meta"), ("meta", "text")):
                own[other].update({place[r]: y for r, y in found[view]})
                taken[view].update(r for r, _ in found[view])
                given.append(len(found[view]))
            model.rounds.append(tuple(given))
            model.text, model.meta = fit("text"), fit("meta")
            continue
        for view, other in (("text", "meta"), ("meta", "text")):
            free = np.array([i for i in pool.tolist() if i not in own[other]], int)
            if not len(free):
                given.append(0)
                continue
            z = model._raw(model.text, [words[i] for i in free], statistics[free]) if view == "text" else model._raw(model.meta, list(metadata[free]), none[free])
            a, b = calibrated(view, choose)
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            k = max(1, int(share * len(pool)) // 2)
            order = np.argsort(p, kind="stable")
            sure = [(i, 0) for i in order[:k] if p[i] <= 0.1] + [(i, 1) for i in order[-k:] if p[i] >= 0.9]
            own[other].update({int(free[i]): y for i, y in sure})
            given.append(len(sure))
        model.rounds.append(tuple(given))
        model.text, model.meta = fit("text"), fit("meta")
    y = labels[final]
    model.prior = float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    model.platt = {view: calibrated(view, final) for view in own}
    model.fitted = True
    return model


def _views(texts: list[str], index: WordIndex, sources: list, langs: list, lengths: list) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    rows, sizes = index.look_up(texts)
    buckets = np.array([r[0] for r in index.rows], np.int64)[rows] if len(rows) else rows
    return np.split(buckets, np.cumsum(sizes)[:-1]), text_statistics(texts, rows, sizes), metadata_features(sources, langs, [len(t) if n is None else n for t, n in zip(texts, lengths, strict=True)])


def _hashed(docs: DataFrame, key: str) -> DataFrame:
    """key, row (a number of each document), source and the features of both views as bytes, written once for all rounds."""
    rows = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), "source", "text", "lang", "n_chars").filter("key IS NOT NULL")

    def make():
        index = WordIndex()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, statistics, metadata = _views(texts_of(batch), index, *(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
            as_bytes = lambda rows, kind: pa.array([x.astype(kind).tobytes() for x in rows], pa.binary())
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "row", "source")), as_bytes(words, np.int16), as_bytes(statistics, np.float64), as_bytes(metadata, np.int16)], ["key", "row", "source", "words", "statistics", "metadata"])

        return one

    schema = f"key {rows.schema['key'].dataType.simpleString()}, row long, source {rows.schema['source'].dataType.simpleString()}, words binary, statistics binary, metadata binary"
    return materialize(map_batches(rows, make, schema, rows=256), "quality-features")


def _stored(words: list[bytes], statistics: list[bytes], metadata: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    return [np.frombuffer(x, np.int16) for x in words], np.frombuffer(b"".join(statistics)).reshape(len(words), -1), np.frombuffer(b"".join(metadata), np.int16).reshape(-1, 3).astype(np.int64)


def _search_of(docs: DataFrame, known: DataFrame, key: str, most_per_source: int, most_per_round: int) -> Search:
    """Looks through all documents of docs whose keys aren't among the known ones."""
    made: list[DataFrame] = []

    def search(views: dict[str, tuple], platt: dict[str, tuple[float, float]], taken: dict[str, set[int]]):
        if not made:
            made.append(_hashed(docs, key))
        features = made[0]
        spark = features.sparkSession
        shared = spark.sparkContext.broadcast((views, platt, {v: np.array(sorted(taken[v]), np.int64) for v in views}))

        def make():
            views, platt, done = shared.value
            model = QualityModel()

            def one(batch: pa.RecordBatch) -> pa.RecordBatch:
                words, statistics, metadata = _stored(*(batch.column(c).to_pylist() for c in ("words", "statistics", "metadata")))
                z = {"text": model._raw(views["text"], words, statistics), "meta": model._raw(views["meta"], list(metadata), np.zeros((len(words), 1)))}
                rows = batch.column("row").to_numpy()
                p = [np.where(np.isin(rows, done[v]), 0.5, 1 / (1 + np.exp(-np.clip(platt[v][0] * z[v] + platt[v][1], -30, 30)))) for v in ("text", "meta")]
                return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "row", "source")), *(pa.array(x, pa.float64()) for x in p)], ["key", "row", "source", "text", "meta"])

            return one

        kind = {f.name: f.dataType.simpleString() for f in features.schema}
        scored = map_batches(features, make, f"key {kind['key']}, row long, source {kind['source']}, text double, meta double")
        sure = scored.filter(" OR ".join(f"{v} >= {_SURE} OR {v} <= 1 - {_SURE}" for v in views)).join(known.select("key"), "key", "left_anti")
        each = F.explode(F.array(*(F.struct(F.lit(v).alias("view"), F.col(v).alias("p")) for v in views)))
        sides = sure.select("row", "source", each.alias("x")).select("row", "source", "x.view", (F.col("x.p") >= 0.5).cast("int").alias("label"), F.abs(F.col("x.p") - 0.5).alias("margin")).filter(F.col("margin") >= _SURE - 0.5)
        n = F.row_number().over(Window.partitionBy("view", "label", "source").orderBy(F.desc("margin"), "row"))
        dealt = sides.withColumn("n", n).filter(F.col("n") <= most_per_source)
        place = F.row_number().over(Window.partitionBy("view", "label").orderBy("n", F.desc("margin"), "row"))
        best = dealt.withColumn("place", place).filter(F.col("place") <= most_per_round).select("view", "label", "place", "row").collect()
        found: dict[str, list[tuple[int, int]]] = {v: [(r["row"], r["label"]) for r in sorted(best) if r["view"] == v] for v in views}
        wanted = spark.createDataFrame(sorted({(r["row"],) for r in best}), "row long")  # at most most_per_round a view and class
        got = features.join(F.broadcast(wanted), "row", "semi").select("row", "words", "statistics", "metadata").collect() if best else []
        parts = {r["row"]: _stored([bytes(r["words"])], [bytes(r["statistics"])], [bytes(r["metadata"])]) for r in got}
        shared.unpersist()
        return found, {r: (w[0].astype(np.int32), t[0], m[0]) for r, (w, t, m) in parts.items()}

    return search


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", sample_per_class: int = SAMPLE_PER_CLASS, most_per_source: int = MOST_PER_SOURCE, most_per_round: int = MOST_PER_ROUND) -> QualityModel:
    """Learns from docs (key, text, source, lang, n_chars) and labels (key, label of 0 or 1): a bounded sample of the labelled documents
    (see SAMPLE_PER_CLASS), whose keys are so few that they may be broadcast, and pseudo-labels from a pass over all others in each round."""
    known = one_label(labels, label, key)
    keys = bounded_sample(known, "label", sample_per_class, "key", "quality")
    rows = docs.select(F.col(key).alias("key"), "text", "source", "lang", "n_chars").filter(F.coalesce(F.length("text"), F.lit(0)) <= MOST_CHARS)
    one = rows.join(F.broadcast(keys), "key").groupBy("key", "label").agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("r"))
    got = one.select("key", "label", "r.*").toPandas().sort_values("key", kind="stable")
    if not len(got):
        return QualityModel()
    index, words, statistics, metadata = WordIndex(), [], [], []
    for s in range(0, len(got), 256):  # in slices, as words weigh more than their buckets
        part = got.iloc[s : s + 256]
        lengths = [None if n != n else int(n) for n in part["n_chars"]]
        w, t, m = _views([x or "" for x in part["text"]], index, list(part["source"]), list(part["lang"]), lengths)
        words += [x.astype(np.int32) for x in w]
        statistics.append(t)
        metadata.append(m)
    search = _search_of(docs, known, key, most_per_source, most_per_round)
    return co_train(words, np.vstack(statistics), np.vstack(metadata), got["label"].to_numpy(), search=search)


def predict(df: DataFrame, model: QualityModel, key: str = "doc_id") -> DataFrame:
    """key, score and the scores of the two views, of every row of df."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(key).alias("__key"), F.col("text").alias("__text"), F.col("source").alias("__source"), F.col("lang").alias("__lang"), F.col("n_chars").alias("__n"))

    def make():
        one, index = shared.value, WordIndex()

        def score(batch: pa.RecordBatch) -> pa.RecordBatch:
            views = _views(texts_of(batch, "__text"), index, *(batch.column(c).to_pylist() for c in ("__source", "__lang", "__n")))
            return pa.RecordBatch.from_arrays([batch.column("__key"), *(pa.array(p, pa.float64()) for p in one.score(*views))], [key, "score", "text_score", "metadata_score"])

        return score

    return map_batches(rows, make, f"`{key}` {rows.schema['__key'].dataType.simpleString()}, score double, text_score double, metadata_score double", rows=256)
