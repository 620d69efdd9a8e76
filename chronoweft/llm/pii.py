"""Personal data: patterns find what is written plainly, a character-level bidirectional LSTM with CRF transitions adds other ways of writing it.

The network is trained in numpy on labelled spans: those that the patterns find in a bounded sample of the texts, as they stand and rewritten by
fixed rules (an address with `at` and `dot`, a telephone number without its plus sign, digits cut otherwise), set into windows of the corpus; windows without
a span are learned as they are. Every text is read whole in overlapping windows. A window's best path gives its spans; of all windows
of a text, the one with a span's middle nearest to its own middle answers for the span, and spans that still overlap go to the earlier and longer. What the network
adds must hold what its kind asks for (valid number of digits, Luhn sum, parts up to 255, an address once `at` and `dot` are read as signs), must gain
more than a limit that is set on windows kept back, and must not overlap a span of the patterns; these always stay. A window in which nothing could
hold what a kind asks for (fewer than four digits, no at sign with a domain after it) isn't put through the network, as none of its spans would be kept.

Cases: a null or empty text has no span. Without a labelled span in the sample the network adds none. Repeated rows get equal results; rows with a
null key are read as all others (but nothing is learned from rows that the caller leaves out). Other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.char_tagger import NOTHING, Tagger, classes_of
from chronoweft.llm.common import bounded_sample, map_batches, small_batches, texts_of
from chronoweft.llm.terms import portions

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the training sample: documents that are searched for labelled spans, and windows of each kind, about.
SAMPLE_DOCUMENTS = 20_000
SAMPLE_WINDOWS = 600
#: Of a text so many spans of a kind are offered for training at most.
_OFFERED = 3
_CONTEXT = 60
#: Training windows, their steps, passes over them; size of the hidden states of a direction.
TRAINED_WINDOWS = 2600
TRAINED_STEPS = 96
EPOCHS = 14
HIDDEN = 8
#: Steps of a window of a text, and how many two neighbours share.
WINDOW, OVERLAP = 384, 64
_TOGETHER = 512

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_WRITTEN_AT = re.compile(r"\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+|\s*@\s*", re.I)
_WRITTEN_DOT = re.compile(r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+", re.I)
#: What an address that holds() accepts has at least, from its at sign on.
_AT = re.compile(r"@|[\[({<]\s*at|\sat\s", re.I)
_AFTER_AT = re.compile(r"\s*(?:[\])}>]\s*)?[A-Za-z0-9-]+(?:\.|\s+dot\s|\s*[\[({<]\s*(?:dot|\.))", re.I)
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

Span = tuple[int, int, int]  # start, kind, end


def digits_of(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def luhn(digits: str) -> bool:
    doubled = [int(d) for d in reversed(digits)]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(doubled)) % 10 == 0


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, not overlapping: an at sign with the longest run before it, no farther back than the match or the at sign before."""
    floor, at = 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by start, then kind."""
    found = [(s, 0, e) for s, e in _addresses(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(found)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def holds(kind: int, text: str) -> bool:
    """True if a span of the network has what its kind asks for."""
    if kind == 0:
        return _ADDRESS.fullmatch(_WRITTEN_DOT.sub(".", _WRITTEN_AT.sub("@", text))) is not None
    if any(c.isalpha() for c in text):
        return False
    digits = digits_of(text)
    if kind == 1:
        parts = _DIGITS.findall(text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and len(_DIGITS.findall(text)) > 1


def may_hold(text: str, classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which windows may have a span that holds() accepts: four digits, or an at sign that a domain follows, however they are written."""
    digits = np.concatenate([[0], np.cumsum((classes >= 48) & (classes <= 57))])
    ends = np.minimum(starts + WINDOW, len(classes))
    may = digits[ends] - digits[starts] >= 4
    for at in _AT.finditer(text):
        if _AFTER_AT.match(text, at.end()):
            may |= (starts <= at.start()) & (at.start() < ends)
    return may


def rewritten(kind: int, text: str, rng: np.random.Generator) -> str:
    """The same value in another way of writing that the patterns don't know."""
    pick = lambda *ways: ways[int(rng.integers(len(ways)))]
    if kind == 0:
        local, _, domain = text.partition("@")
        return local + pick(" at ", " [at] ", " (at) ", "[at]", "(at)", " @ ") + domain.replace(".", pick(" dot ", " [dot] ", "[dot]", "(dot)", "."))
    groups = _DIGITS.findall(text)
    if kind == 1:
        return pick("[.]", "(.)", " . ", "-", ",").join(groups)
    digits = "".join(groups)
    if kind == 2:
        return pick(".", "/", "  ", " - ", "_").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    body, head = digits[:-10] + " " if len(digits) > 10 and rng.random() < 0.3 else "", digits[-10:]
    return (body + pick("({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "{0} {1} {2}", "({0}){1} {2}")).format(head[:3], head[3:6], head[6:])


def varied(text: str, rng: np.random.Generator) -> str:
    """Other digits in the same places, so that no single value is learned."""
    return "".join(str(rng.integers(10)) if "0" <= c <= "9" else c for c in text)


def labelled_windows(docs: DataFrame, text: str = "text", key: str = "doc_id", documents: int = SAMPLE_DOCUMENTS, windows: int = SAMPLE_WINDOWS) -> DataFrame:
    """kind, window, start, end: windows with a span of the patterns, of kind `other` with digits or signs that are none, and of kind `none`."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.lit(0).alias("all")).filter("text IS NOT NULL")
    sample = bounded_sample(rows, "all", documents, "key", "pii").select("text")

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str, str, int, int]] = []
            for t in texts_of(b):
                spans, seen = base_spans(t), [0] * len(KINDS)
                for s, k, e in spans:
                    if seen[k] < _OFFERED and e - s <= OVERLAP:
                        seen[k] += 1
                        out.append((KINDS[k], t[max(0, s - _CONTEXT) : e + _CONTEXT], min(s, _CONTEXT), min(s, _CONTEXT) + e - s))
                length = TRAINED_STEPS
                other = [m for m in re.finditer(r"[0-9@+][^\s]{3}", t) if not any(s - length < m.start() < e + length for s, _, e in spans)][: 20 * _OFFERED : 20]
                out += [("other", t[max(0, m.start() - length // 2) : m.start() + length // 2], 0, 0) for m in other]
                place = int.from_bytes(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:6], "big") % max(len(t) - length, 1)
                if not any(s < place + length and e > place for s, _, e in spans):
                    out.append(("none", t[place : place + length], 0, 0))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))], ["kind", "window", "start", "end"])

    offered = sample.mapInArrow(offer, "kind string, window string, start int, end int").distinct()
    return bounded_sample(offered, "kind", windows, "window", "windows")


@dataclass
class PersonalDataModel:
    """Empty until fit; then a tagger and the least gain of a span that is added."""

    tagger: Tagger | None = None
    least_gain: float = 0.0

    def train(self, windows: list[tuple[str, str, int, int]], seed: int = 11) -> None:
        """windows: kind, text, start and end of the span."""
        rng = np.random.default_rng(seed)
        windows = sorted(windows)
        spans = {k: [w[w_s:w_e] for kind, w, w_s, w_e in windows if kind == name] for k, name in enumerate(KINDS)}
        known = [k for k in spans if spans[k]]
        around = [w for kind, w, _, _ in windows if kind == "none"] or [" "]
        other = [w for kind, w, _, _ in windows if kind == "other"]
        if not known:
            return
        classes = np.full((TRAINED_WINDOWS, TRAINED_STEPS), NOTHING, np.uint8)
        tags = np.zeros((TRAINED_WINDOWS, TRAINED_STEPS), np.int64)
        for n in range(TRAINED_WINDOWS):
            if other and n % 5 == 0:
                text, placed = varied(other[int(rng.integers(len(other)))], rng), []
            else:
                text, placed = around[int(rng.integers(len(around)))], []
                text = text[: int(rng.integers(20, TRAINED_STEPS))] if rng.random() < 0.2 else text
                for _ in range(int(rng.integers(0, 3))):
                    kind = known[int(rng.integers(len(known)))]
                    own = varied(spans[kind][int(rng.integers(len(spans[kind])))], rng)
                    own = rewritten(kind, own, rng) if rng.random() < 0.6 else own
                    cuts = [i for i, c in enumerate(text) if c == " " and all(not s <= i < e for s, e, _ in placed)] or [len(text)]
                    at = cuts[int(rng.integers(len(cuts)))] + 1
                    end = text[at - 1 : at] and rng.choice([" ", " ", " ", ", ", ". ", "### ", "\n"])
                    placed = [(s, e, k) if e <= at else (s + len(own) + len(end), e + len(own) + len(end), k) for s, e, k in placed]
                    text, placed = text[:at] + own + end + text[at:], [*placed, (at, at + len(own), kind)]
            found = classes_of(text[:TRAINED_STEPS])
            classes[n, : len(found)] = found
            for s, e, k in placed:
                tags[n, s:e] = 2 + 2 * k
                tags[n, s : s + 1] = 1 + 2 * k
        kept_back = np.arange(TRAINED_WINDOWS) % 6 == 0
        self.tagger = Tagger.fresh(len(KINDS), HIDDEN, seed)
        self.tagger.train(classes[~kept_back].T.copy(), tags[~kept_back].T.copy(), EPOCHS)
        self._calibrate(classes[kept_back].T.copy(), tags[kept_back].T)

    def _calibrate(self, classes: np.ndarray, tags: np.ndarray) -> None:
        """The least gain from which on 95 of 100 spans of the windows kept back touch a span of their kind."""
        right = sorted(((g, bool(np.isin(tags[s:e, w], (1 + 2 * k, 2 + 2 * k)).mean() > 0.5)) for w, s, e, k, g in self.tagger.spans(classes)), reverse=True)
        hits = np.cumsum([r for _, r in right])
        good = np.flatnonzero(hits >= 0.95 * np.arange(1, len(right) + 1)) if right else []
        self.least_gain = right[good[-1]][0] if len(good) else float("inf")

    def added(self, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
        """Of each text the spans that the network adds."""
        out: list[list[Span]] = [[] for _ in texts]
        if self.tagger is None:
            return out
        step = WINDOW - OVERLAP
        codes = [classes_of(t) for t in texts]
        starts = [np.arange(max(1, -(-(len(c) - OVERLAP) // step)) if len(c) else 0) * step for c in codes]
        starts = [s[may_hold(t, c, s)] for t, c, s in zip(texts, codes, starts, strict=True)]
        flat = np.concatenate([*codes, np.full(WINDOW, NOTHING, np.uint8)])
        sizes = np.array([len(c) for c in codes])
        offset = np.cumsum(sizes) - sizes
        text, start = np.repeat(np.arange(len(texts)), [len(s) for s in starts]), np.concatenate(starts)
        found: list[list[tuple[float, int, int, int, float]]] = [[] for _ in texts]
        for s in range(0, len(text), _TOGETHER):
            own, begin = text[s : s + _TOGETHER], start[s : s + _TOGETHER]
            steps = np.arange(WINDOW)[:, None]
            places = begin + steps
            classes = np.where(places < sizes[own], flat[np.minimum(offset[own] + places, len(flat) - 1)], np.uint8(NOTHING))
            for w, a, b, kind, gain in self.tagger.spans(np.ascontiguousarray(classes)):
                t, at = int(own[w]), int(begin[w])
                b = min(b, int(sizes[t]) - at)
                if gain > self.least_gain and b > a:
                    found[t].append((abs((a + b) / 2 - WINDOW / 2), at + a, at + b, kind, gain))
        for t, spans in enumerate(found):
            out[t] = self._reconciled(texts[t], spans, base[t])
        return out

    def _reconciled(self, text: str, spans: list[tuple[float, int, int, int, float]], base: list[Span]) -> list[Span]:
        """Spans of all windows of one text, each as the window sees it that has it nearest to its middle, in order and apart."""
        taken: list[Span] = []
        for _, s, e, kind, _ in sorted(spans):
            while s < e and text[s] in " \n\t.,;:":
                s += 1
            while s < e and text[e - 1] in " \n\t.,;:":
                e -= 1
            if holds(kind, text[s:e]) and all(e <= a or s >= b for a, _, b in (*taken, *base)):
                taken.append((s, kind, e))
        return sorted(taken)


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id") -> PersonalDataModel:
    """Learns from a bounded sample of docs (see SAMPLE_DOCUMENTS and SAMPLE_WINDOWS)."""
    model = PersonalDataModel()
    model.train([tuple(r) for r in labelled_windows(docs, text, key).collect()])
    return model


def find(df: DataFrame, model: PersonalDataModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key, n_<kind> of the patterns, and found: start, kind, end and whether the network added it, of all spans of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("__text"))

    def make():
        own = shared.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch, "__text")
            base = [base_spans(t) for t in texts]
            more = [x for s, e in portions(texts) for x in own.added(texts[s:e], base[s:e])]
            counts = [pa.array([sum(k == kind for _, k, _ in b) for b in base], pa.int64()) for kind in range(len(KINDS))]
            every = [sorted([(*x, False) for x in b] + [(*x, True) for x in m]) for b, m in zip(base, more, strict=True)]
            flat = [x for e in every for x in e]
            fields = [pa.array([x[0] for x in flat], pa.int64()), pa.array([KINDS[x[1]] for x in flat], pa.string()), pa.array([x[2] for x in flat], pa.int64()), pa.array([x[3] for x in flat], pa.bool_())]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(e) for e in every])]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "kind", "end", "added"]))
            return pa.RecordBatch.from_arrays([batch.column("id"), *counts, lists], ["id", *(f"n_{k}" for k in KINDS), "found"])

        return one

    schema = f"id {rows.schema['id'].dataType.simpleString()}, {', '.join(f'n_{k} long' for k in KINDS)}, found array<struct<start:long,kind:string,end:long,added:boolean>>"
    return map_batches(rows, make, schema, rows=256, operator="pii").withColumnRenamed("id", key)


def masked(df: DataFrame, found: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df with [kind] in place of each span, joined by key (rows whose key is null or repeated are left as they are); the same columns.

    Spans that overlap are masked together, under the kind of the first.
    """
    one = found.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"), F.first("found").alias("__found")).filter("__n = 1")
    step = F.expr(
        "aggregate(__found, struct(0L AS at, '' AS done), (a, x) -> CASE WHEN x.start < a.at THEN struct(greatest(a.at, x.end) AS at, a.done AS done)"
        f" ELSE struct(x.end AS at, concat(a.done, substring(`{text}`, int(a.at) + 1, int(x.start - a.at)), '[', x.kind, ']') AS done) END,"
        f" a -> concat(a.done, substring(`{text}`, int(a.at) + 1)))"
    )
    rows = df.join(one, F.col(key) == F.col("__key"), "left")
    return rows.select(*(F.when(F.size("__found") > 0, step).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in df.columns))
