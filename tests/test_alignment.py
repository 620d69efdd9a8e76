"""Script alignment against plain loops over all pairs."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from chronoweft.operators import alignment

SF = "/root/testdata/sf0.001"


def plain_words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] in "LN":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_alignment(a, b):
    """Cell by cell."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    best = max(map(max, h))
    if not best:
        return (0,) * 6
    j, i = min((j, i) for i in range(len(a) + 1) for j in range(len(b) + 1) if h[i][j] == best)
    to, equal = (i, j), 0
    while h[i][j]:
        same = a[i - 1] == b[j - 1]
        if h[i][j] == h[i - 1][j - 1] + (2 if same else -1):
            i, j, equal = i - 1, j - 1, equal + same
        elif h[i][j] == h[i - 1][j] - 1:
            i -= 1
        else:
            j -= 1
    return i, to[0], j, to[1], best, equal


def plain_seeds(targets, sources):
    """(t, s) -> {(i, j)}, without the choice of the rarest."""
    out = defaultdict(set)
    for t, a in targets:
        n = min(3, len(a))
        for s, b in sources:
            out[t, s] |= {(i, j) for i in range(len(a) - n + 1) for j in range(len(b) - n + 1) if n and a[i : i + n] == b[j : j + n]}
    return {k: v for k, v in out.items() if v}


def plain_takes(targets, sources, rarest=None):
    found, words, texts = plain_seeds(targets, sources), dict(targets), dict(sources)
    places = Counter((t, i) for (t, _), ij in found.items() for i, _ in ij)
    out = set()
    for (t, s), ij in found.items():
        if rarest:
            assert all(sum(1 for (u, _) in places if u == t) <= rarest for t in words)
        js, a, b = sorted({j for _, j in ij}), words[t], texts[s]
        groups = [[js[0]]]
        for j in js[1:]:
            groups.append([j]) if j - groups[-1][-1] > len(a) else groups[-1].append(j)
        for g in groups:
            begin = max(0, g[0] - len(a))
            got = plain_alignment(a, b[begin : g[-1] + 3 + len(a)])
            out.add((t, s, got[0], got[1], got[2] + begin, got[3] + begin, got[4], got[5]))
    return out


def plain_path(spans):
    """Exhaustive: the highest sum of spans that begin and end one after another, shared words counted once, by the fewest spans."""
    value = lambda c: sum(x[2] for x in c) - sum(2 * max(0, x[1] - y[0]) for x, y in zip(c, c[1:], strict=False))
    return max((value(c), -len(c)) for r in range(len(spans) + 1) for c in combinations(spans, r) if all(x[0] < y[0] and x[1] < y[1] for x, y in zip(c, c[1:], strict=False)))


def rows_of(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, text string").withColumn("i", F.lit("clash")).withColumn("places", F.lit("clash"))


def test_local_alignment_like_plain():
    rng = random.Random(1)
    for _ in range(400):
        a, b = (rng.choices("abcd", k=rng.randrange(9)) for _ in range(2))
        assert alignment.local_alignment(a, b) == plain_alignment(a, b), (a, b)


def test_exact_passages_are_taken_whole():
    """As much of a take as the target has, no more: a target within longer speech is cut to its words."""
    a = "we show the result after one cut".split()
    assert alignment.local_alignment(a, [*"well then".split(), *a, *"and on".split()]) == (0, 7, 2, 9, 14, 7)


def test_best_path_like_exhaustive():
    rng = random.Random(2)
    for _ in range(300):
        spans = sorted({(f, f + rng.randint(1, 5), rng.randint(1, 9)) for f in (rng.randrange(10) for _ in range(rng.randrange(8)))}, key=lambda s: (s[1], s[0]))
        path = alignment.best_path(spans)
        chosen = [spans[k] for k in path]
        value = sum(s[2] for s in chosen) - sum(2 * max(0, x[1] - y[0]) for x, y in zip(chosen, chosen[1:], strict=False))
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(chosen, chosen[1:], strict=False)) and (value, -len(chosen)) == plain_path(spans)


def test_takes_like_all_pairs_on_tables(spark):
    targets, sources = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("benchmark", "documents"))
    a = [(r.item_id, plain_words(r.text)) for r in targets.collect()]
    b = [(r.doc_id, plain_words(r.text)) for r in sources.collect()]
    got = alignment.takes(targets, sources, "item_id", "doc_id", rarest=1 << 30)
    assert {tuple(r) for r in got.collect()} == plain_takes(a, b)


def test_paths_of_made_up_scripts(spark):
    """A target said in two takes, one of them in two sources, and a passage with a word left out."""
    script = "first we open the box and then we take the lamp out of it before we close the box again"
    sources = [(1, "So: first we open the box, and then we stop."), (2, "er then we take the lamp out before we close the box again, right"), (3, "first we open the box and then"), (4, None), (5, "nothing of it"), (6, "First WE open the box and then")]
    targets = [(1, script), (2, ""), (3, "lamp"), (4, None), (5, "nothing of the kind at all is here")]
    t, s = rows_of(spark, targets, "item"), rows_of(spark, sources, "take_of")
    got = [tuple(r) for r in alignment.assemble(alignment.takes(t, s, "item", "take_of"), t, "item", "take_of").orderBy("item", "take").collect()]
    of_one = [r for r in got if r[0] == 1]
    assert [(r[2], r[3], r[4]) for r in of_one] == [(1, 0, 8), (2, 6, 20)] and {r[-1] for r in of_one} == {"matched"} and of_one[1][7] == 2  # runs that several sources have aren't among the rarest
    assert [(r[2], r[3], r[4], r[5], r[6]) for r in got if r[0] == 3] == [(2, 0, 1, 5, 6)] and not [r for r in got if r[0] in (2, 4, 5)]
    assert alignment.takes(t.limit(0), s, "item", "take_of").count() == 0 and alignment.takes(t, s.limit(0), "item", "take_of").count() == 0


def test_rarest_runs(spark):
    """With one run a target the rarest is looked for, not the first."""
    sources = rows_of(spark, [(k, "one two three four") for k in range(5)] + [(9, "two three four five")], "take_of")
    t = rows_of(spark, [(1, "one two three four five")], "item")
    got = alignment.seeds(t, sources, "item", "take_of", rarest=1).collect()
    assert [(r.take_of, r.i, r.j) for r in got] == [(9, 2, 1)]


SCRIPT = """# Opening
- **Hello** there.  How are you? Fine
1. Next `one`
```
code # not spoken
```
## The   part
[x] done; 你好！再见
   * item here
--- !!
end"""


@pytest.mark.parametrize("sentences", [False, True])
def test_target_units(spark, sentences):
    df = spark.createDataFrame([(1, SCRIPT), (2, None), (3, ""), (4, "a\r\nb")], "k long, text string")
    got = [(r.k, r["index"], r.section, r.text) for r in alignment.target_units(df, "k", sentences=sentences).orderBy("k", "index").collect()]
    lines = [("Opening", "Hello there. How are you? Fine"), ("Opening", "Next one"), ("The part", "done; 你好！再见"), ("The part", "item here"), ("The part", "end")]
    if sentences:
        lines = [(s, p.strip()) for s, x in lines for p in re.findall(r".+?(?:[。！？!?；;]|\.(?=\s|$)|$)", x)]
    assert got == [(1, n, *x) for n, x in enumerate(lines, 1)] + [(4, 1, "", "a"), (4, 2, "", "b")]
