"""The training-data operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names; and against brute force."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from chronoweft.llm import fingerprints, html_consensus, language_id, ngram_join, packing, piece_bpe, quality_cotraining, queries, repeated_lines, tool_calls, toxicity
from chronoweft.llm.hashed_words import WordVectors

WORDS = {"en": "the and that with from this have which their would about there", "de": "der und nicht mit eine auch werden über für können daß straße", "fr": "les dans une avec pour être était où très même après élève"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = 20_000


def sentences(lang: str, n: int, rng: random.Random) -> str:
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "", ",", "."]) for _ in range(n))


def corpus(seed: int = 1, n: int = 240) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = ("en", "de", "fr")[k % 3]
        text = sentences(lang, rng.randrange(5, 120), rng)
        if k % 4 == 0:
            text += " awful idiot trash"
        out.append((k, text, lang, f"s{k % 5}", len(text)))
    return out


def odd_rows(first: int = 1000) -> list[tuple]:
    rng = random.Random(3)
    long = sentences("en", LONG, rng)
    return [(first, None, None, None, None), (first + 1, "", "en", "s1", 0), (first + 2, " \n\t ", None, "s1", 4), (first + 3, "12345 !!! ???", "xx", None, None), (first + 4, long, "en", "s2", len(long)), (first + 5, "\n".join(["same line here"] * 80), "en", "s0", 9), (first + 6, "🙂 漢字 ▁ <|endoftext|> \x00 é", None, "s1", 3), (first + 6, "🙂 漢字 ▁ <|endoftext|> \x00 é", None, "s1", 3)]


CLASHES = ["score", "lang_pred", "key", "id", "h", "n", "label", "kept", "component", "component_id", "digest", "salt", "class", "place", "row", "part", "kind", "host", "fingerprint", "sequence_id", "signature", "prefix"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus() + odd_rows(), SCHEMA)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, (k // 2) % 2, int(k % 4 == 0)) for k in range(0, 200)] + [(3, None, None), (None, 1, 1), (5, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("key", F.lit("clash"))


def empty(docs):
    return docs.limit(0)


# ---- language ID


def test_language_id(docs):
    model = language_id.fit(docs.filter("doc_id % 2 = 0 AND doc_id < 1000"))
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    truth = {k: lang for k, _, lang, _, _ in corpus()}
    assert sum(got[k]["lang_pred"] == lang for k, lang in truth.items()) >= 0.98 * len(truth)
    for k in (1000, 1001, 1002, 1003):
        assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
    assert got[1004]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.predict(empty(docs), model).count() == 0
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({1000, 1001, 1002, 1003})


def test_language_id_without_training(docs):
    model = language_id.fit(empty(docs))
    assert {r["lang_pred"] for r in language_id.predict(docs, model).collect()} == {"und"}


def test_language_scores_are_the_bayes_sums():
    logs = np.zeros((2, (1 << language_id.BUCKET_BITS) + 1), np.float32)
    rng = np.random.default_rng(0)
    logs[:, :-1] = rng.normal(size=(2, 1 << language_id.BUCKET_BITS))
    texts = ["ab c", "xyz", "é"]
    grams, starts, _ = language_id.sparse_ngrams(texts)
    want = [[sum(float(logs[lang, g[i]]) for g in grams for i in range(a, b)) for lang in range(2)] for a, b in zip(starts, [*starts[1:], grams.shape[1]], strict=True)]
    got, _ = language_id.LanguageModel(["a", "b"], logs).score(texts)
    assert got == ["ab"[int(np.argmax(w))] for w in want]


# ---- toxicity


def test_toxicity(docs, labels):
    model = toxicity.fit(docs, labels, language_id.fit(docs.filter("doc_id < 1000")))
    got = {r["doc_id"]: r["score"] for r in toxicity.predict(docs, model).collect()}
    test = range(200, 240)
    assert sum((got[k] >= 0.5) == (k % 4 == 0) for k in test) >= 0.95 * len(test)
    assert all(0 <= s <= 1 for s in got.values()) and {1000, 1001} <= got.keys()
    assert toxicity.predict(empty(docs), model).count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns


def test_toxicity_without_labels(docs, labels):
    model = toxicity.fit(docs, labels.limit(0), language_id.LanguageModel([], np.zeros((0, 1))))
    assert {r["score"] for r in toxicity.predict(docs, model).collect()} == {0.0}


def test_pooling_against_plain_loops():
    rng = np.random.default_rng(1)
    model = toxicity.ToxicityModel(language_id.LanguageModel([], np.zeros((0, 1))))
    model.embeddings = rng.normal(size=(toxicity.BUCKETS, toxicity.DIMENSIONS)).astype(np.float32)
    model.filters = {w: rng.normal(size=(w, toxicity.DIMENSIONS, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS}
    model.out, model.bias = rng.normal(size=len(toxicity.WIDTHS) * toxicity.FILTERS).astype(np.float32), 0.25
    texts = ["one two three four", "", "single"]
    got = model.logits_of_vectors(*WordVectors(model.embeddings).rows_of(texts))
    for text, z in zip(texts, got, strict=True):
        x = WordVectors(model.embeddings).rows_of([text])[0] if text else np.zeros((1, toxicity.DIMENSIONS))
        padded = np.vstack([x, np.zeros((2, toxicity.DIMENSIONS))])
        pooled = [max(sum(padded[i + k] @ model.filters[w][k][:, f] for k in range(w)) for i in range(len(x))) for w in toxicity.WIDTHS for f in range(toxicity.FILTERS)]
        assert abs(z - (np.maximum(pooled, 0) @ model.out + 0.25)) < 1e-3


# ---- quality


def test_quality(docs, labels):
    """Every fourth document is junk: symbols behind its words."""
    good = labels.withColumn("quality", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1))
    junk = docs.withColumn("text", F.when((F.col("doc_id") % 4 == 0) & (F.col("doc_id") < 1000), F.regexp_replace("text", " ", "### ")).otherwise(F.col("text")))
    model = quality_cotraining.fit(junk, good)
    got = {r["doc_id"]: r["score"] for r in quality_cotraining.predict(junk, model).collect()}
    assert sum((got[k] < 0.5) == (k % 4 == 0) for k in range(200, 240)) >= 38
    assert model.rounds and all(0 <= s <= 1 for s in got.values()) and 1000 in got
    assert quality_cotraining.predict(empty(docs), model).count() == 0
    assert {r["score"] for r in quality_cotraining.predict(docs, quality_cotraining.fit(docs, good.limit(0))).collect()} == {0.5}


def test_views_teach_each_other():
    """The text view has few labels; pseudo-labels of the metadata view, which is sure, reach it."""
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 2, 600)
    words = [np.concatenate([[7 + t], rng.integers(100, 30000, 5)]) for t in truth]
    metadata = np.stack([truth * 10 + 1, rng.integers(20, 40, 600), rng.integers(50, 60, 600)], 1)
    labels = np.where(np.arange(600) < 60, truth, -1)
    model = quality_cotraining.co_train(words, np.zeros((600, 8)), metadata, labels)
    assert any(meta > 0 for _, meta in model.rounds)
    score, text, meta = model.score(words, np.zeros((600, 8)), metadata)
    assert ((score >= 0.5) == truth).mean() > 0.97


def test_every_unlabelled_document_may_be_labelled(spark):
    """Sources of one document each, none of them labelled, beside a hot source of thousands: all reach the metadata view."""
    rng = random.Random(9)
    text = lambda k: sentences("en", 60, rng).replace(" ", " " if k % 2 else "### ")
    rows = [(k, text(k), "en", "hot" if k < 5000 else f"rare {k}", 70) for k in range(5012)]
    model = quality_cotraining.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(k, k % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int"))
    weights = [model.meta[0][quality_cotraining.metadata_features([f"rare {k}"], ["en"], [70])[0][0]] for k in range(5000, 5012)]
    assert all(w > 0 if k % 2 else w < 0 for k, w in enumerate(weights))


# ---- tool calls


def test_tool_calls(spark):
    calls = [(1, 0, "a", None, "answer", '{"turn":1,"query":"x"}'), (1, 2, "b", "a", "answer", '{"query":5,"turn":2,"z":{"b":1,"a":[2]}}'), (1, 4, "c", "b", "answer", "not json"), (1, 6, "d", "nowhere", "other", "{}"), (1, 8, None, None, "answer", None), (2, 0, "p", "q", "answer", None), (2, 2, "q", "p", "answer", "[]"), (2, 4, "r", "q", "answer", '{"query":"","turn":1}'), (1, 9, "a", None, "answer", '{"later":1}'), (1, 0, "a", None, "answer", '{"turn":1,"query":"x"}')]
    results = [(1, 1, "a", "yes"), (1, 1, "a", "yes"), (1, 3, "b", None), (3, 1, "lost", "?"), (3, 2, None, "?")]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, parent_id string, name string, arguments string").withColumn("level", F.lit("clash"))
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string").withColumn("status", F.lit("clash"))
    got = {(x["call_id"], x["status"]): x for x in tool_calls.link(c, r, tool_calls.TURN_SCHEMAS).collect()}
    assert {k: v["level"] for k, v in got.items()} == {("a", "linked"): 0, ("b", "linked"): 1, ("c", "unanswered"): 2, ("d", "unanswered"): 0, (None, "no_id"): 0, ("p", "cyclic"): None, ("q", "cyclic"): None, ("r", "cyclic"): None, ("lost", "orphan"): None}
    assert got["a", "linked"]["valid"] and got["a", "linked"]["json"] == '{"arguments":{"query":"x","turn":1},"id":"a","name":"answer","result":"yes"}'
    assert got["b", "linked"]["errors"] == "query: not string; unknown: z" and '"z":{"a":[2],"b":1}' in got["b", "linked"]["json"]
    assert got["c", "unanswered"]["errors"] == "no object" and got["d", "unanswered"]["errors"] == "no schema" and got["r", "cyclic"]["errors"] == "query: too short"
    assert tool_calls.link(c.limit(0), r.limit(0), tool_calls.TURN_SCHEMAS).count() == 0


def test_tool_calls_keep_every_row(spark):
    """One identifier in several conversations, hot and repeated identifiers, none at all, and turns of another role."""
    calls = [(c, 0, "call_1", None, "answer", '{"turn":0,"query":"x"}') for c in (1, 2, None)] + [(2, 2, "call_2", "call_1", "answer", "{}"), (3, 0, "call_2", "call_1", "answer", "{}"), (1, 4, None, None, "answer", "{}")]
    calls += [(4, 0, "hot", None, "answer", "{}")] * 20 + [(4, 9, "hot", None, "answer", '{"later":1}')]
    results = [(1, 1, "call_1", "one"), (2, 1, "call_1", "two"), (None, 1, "call_1", "none"), (2, 3, "call_1", "again"), (4, 1, "hot", "h"), (4, 1, "hot", "h"), (5, 1, None, "lost"), (None, None, None, None)]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, parent_id string, name string, arguments string").withColumn("row", F.lit("clash"))
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string").withColumn("key", F.lit("clash"))
    o = spark.createDataFrame([(1, 0, "be kind"), (None, None, None)], "conv_id long, turn long, content string")
    got = tool_calls.link_all(c, r, tool_calls.TURN_SCHEMAS, o).collect()
    assert Counter((x["conv_id"], x["call_id"], x["status"], x["level"], json.loads(x["json"])["result"]) for x in got) == Counter(
        {(1, "call_1", "linked", 0, "one"): 1, (2, "call_1", "linked", 0, "two"): 1, (None, "call_1", "linked", 0, "none"): 1, (2, "call_2", "unanswered", 1, None): 1, (3, "call_2", "unanswered", 0, None): 1, (1, None, "no_id", 0, None): 1}
        | {(4, "hot", "linked", 0, "h"): 1, (4, "hot", "duplicate", None, None): 20, (4, "hot", "duplicate", None, "h"): 1, (2, "call_1", "duplicate", None, "again"): 1, (5, None, "no_id", None, "lost"): 1, (None, None, "no_id", None, None): 1}
        | {(1, None, "other_role", None, "be kind"): 1, (None, None, "other_role", None, None): 1}
    )
    linked = sum(x["status"] == "linked" for x in got)
    assert len(got) == c.count() + r.count() + o.count() - linked
    counting = tool_calls.link(c, r, tool_calls.TURN_SCHEMAS).collect()
    assert len(counting) == 7 and {x["conv_id"] for x in counting if x["status"] == "linked"} == {1, 2, 4, None}


def test_levels_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").cast("string").alias("call_id"), (F.col("id") - 1).cast("string").alias("parent_id"))
    assert all(int(r["call_id"]) == r["level"] for r in tool_calls.levels(chain).collect())


# ---- repeated lines


def brute_base(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = {}
    for k in range(len(words) - 2):
        grams.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {k + o for at in grams.values() if len(at) > 1 for k in at for o in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_repeated_lines(docs, spark):
    got = {r["doc_id"]: r for r in repeated_lines.verdicts(docs).collect()}
    for k, text, *_ in corpus() + odd_rows():
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_base(text)
    assert got[1000]["base_failed"] and not got[1000]["kept"] and got[1005]["n_dup_lines"] == 79
    assert repeated_lines.verdicts(empty(docs)).count() == 0


def test_frequent_lines_are_removed(spark):
    rng = random.Random(5)
    body = lambda: sentences("en", 60, rng)
    rows = [(k, f"{body()}\nSubscribe  to OUR letter", "en", "host" if k % 2 else None, 1) for k in range(20)] + [(100 + k, "\n".join(["subscribe to our letter"] * 20 + [sentences("en", 55, rng)]), "en", "host", 1) for k in range(3)] + [(200, "subscribe to our letter " + body(), "en", "other", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    judged = repeated_lines.verdicts(df, most_documents=5)
    got = {r["doc_id"]: r for r in judged.collect()}
    assert all(got[k]["removed_words"] == 4 and got[k]["kept"] == (not got[k]["base_failed"]) for k in range(20))
    assert all(got[k]["removed_words"] == 80 and not got[k]["kept"] for k in (100, 101, 102)) and got[200]["removed_words"] == 0
    kept = {r["doc_id"]: r["text"] for r in repeated_lines.cleaned(df, judged).collect()}
    assert all("Subscribe" not in kept[k] for k in range(20) if k in kept) and "subscribe" in kept.get(200, "subscribe")


# ---- HTML


def test_html(spark):
    page = lambda k: f'<html><head><title>T</title></head><body><nav><ul><li><a href="/a">Home page</a></ul></nav><div class="post post-{k}"><h1>Head {k} &amp; more</h1><p>First long paragraph of the article number {k} <b>bold</b><br>next line<p>Second\n  one &lt;i&gt;<script>var x="</p>"</script></div><div class="comments"><p>bad comment here that is long enough to count as text</p></div><footer>foot</footer></body></html>'
    rows = [(k, f"https://Host.example:80/p/{k}", page(k)) for k in range(4)] + [(10, None, None), (11, "https://host.example/x", ""), (12, "bad url", "no markup &eacute; <b>at all"), (13, "https://host.example/y", "<div class='post post-9'>short</div><div class=big><p>" + "other words " * 50 + "</div><!-- open"), (3, "https://Host.example:80/p/3", page(3))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = [(r["page_id"], r["text"]) for r in html_consensus.extract(df).collect()]
    texts = dict(got)
    assert len(got) == 9 and texts[2] == "Head 2 & more\nFirst long paragraph of the article number 2 bold\nnext line\nSecond one <i>"
    assert (texts[10], texts[11], texts[12]) == ("", "", "no markup é at all") and texts[13].startswith("other words")
    assert html_consensus.extract(df.limit(0)).count() == 0
    assert {r["path"].split("#")[0] for r in html_consensus.host_paths(df.filter("page_id < 4")).collect()} == {"html/body/div.post.post-0"}


def test_html_with_several_content_containers(spark):
    lead, body, tail = "lead words of it " * 10, "the body words of it " * 20, "last words of it " * 8
    items = "".join(f"<li>entry {n} of the long list</li>" for n in range(30))
    shapes = {
        "parts": (f"<article><h1>Title</h1><div class=lead>{lead}</div><div class=entry-content><p>{body}</p></div><div>{tail}</div></article>", ["Title", lead, body, tail]),
        "list": (f"<article><h1>Title</h1><p>{lead}</p><ul>{items}</ul><p>{tail}</p></article>", ["Title", lead, *(f"entry {n} of the long list" for n in range(30)), tail]),
        "table": (f"<div class=post><p>{lead}</p><table><tr><td>{body}</td></tr></table><p>{tail}</p></div>", [lead, body, tail]),
    }
    page = lambda x: f"<html><body><nav><a href=/>Home page</a></nav><div class=links><a href=/1>one more page</a></div>{x}<footer>foot</footer></body></html>"
    rows, expected = [], {}
    for h, (markup, blocks) in enumerate(shapes.values()):
        for k in range(4):
            rows.append((10 * h + k, f"https://h{h}.example/{k}", page(markup)))
            expected[10 * h + k] = "\n".join(" ".join(b.split()) for b in blocks)
    # A page with more than the others of its host: content beside the winning path stays.
    rows.append((5, "https://h0.example/5", page(shapes["parts"][0] + f"<div class=more><p>{tail}</p></div>")))
    expected[5] = expected[0] + "\n" + tail.strip()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_consensus.extract(df).collect()} == expected


ARTICLE = [f"Paragraph {k} of the article with several words in it." for k in range(6)]


def marked_up(before: str = "", after: str = "") -> str:
    return "<body><nav><a href=/>Home page of all</a></nav>" + before + "".join(f"<p>{t}</p>" for t in ARTICLE) + after + "<div class='sidebar'><p>Words at the side of it</p></div><footer>foot of it</footer>"


@pytest.mark.parametrize(
    ("before", "after", "first"),
    [
        ("<div class='overflow-hidden'><article>", "</article></div>", None),
        ("<div class='content no-sidebar has-footer'>", "</div>", None),
        ("<div class='page-header'><main>", "</main></div>", None),
        ("<div id='comments-page'>", "</div>", None),
        ("<article><header><h1>The head</h1><p>By someone else</p></header>", "</article>", "The head"),
        ("<div class='site-header'><h2>Site name of all</h2></div><section>", "</section><ul class='post-comments'><li>a comment of some length</li></ul>", None),
        ("<div class='col-side main'>", "</div><div aria-hidden=true><p>not shown at all here</p></div>", None),
    ],
)
def test_boilerplate_by_whole_names(before, after, first):
    page = html_consensus.read(marked_up(before, after))
    assert page.extract(page.best()[0][0]) == "\n".join([first, *ARTICLE] if first else ARTICLE)


def test_odd_pages():
    links = html_consensus.read("<body><article>" + "".join(f"<p>See <a href=/{k}>{t}</a> now</p>" for k, t in enumerate(ARTICLE)) + "</article>")
    assert links.extract(links.best()[0][0]) == "\n".join(f"See {t} now" for t in ARTICLE)
    figure = html_consensus.read("<article><p>A text of some length here.</p><figure><img src=x><figcaption>What one sees here</figcaption></figure></article>")
    assert figure.extract(figure.best()[0][0]).endswith("What one sees here")
    deep = html_consensus.read("<div class='a b'>" * 50_000 + "<p>Deep down there is a text.</p>" + "</section></div>" * 50_000 + "<p>And a text after it all.</p>")
    assert deep.extract(deep.best()[0][0]) == "Deep down there is a text.\nAnd a text after it all." and len(deep.path(50_000)) < 1000
    only_boilerplate = html_consensus.read("<div class='promo'><p>One text of it all</p></div><div class='banner'><p>Another text of it all</p></div>")
    assert only_boilerplate.extract(only_boilerplate.best()[0][0]) == "One text of it all\nAnother text of it all"


class SlowExtractor(HTMLParser):
    """Blocks of a page outside nav, footer, head and adverts, by the parser of the standard library."""

    BLOCKS = frozenset("p h1 li br div article ul nav footer body".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.skip = [], [], []

    def end(self):
        if block := " ".join("".join(self.text).split()):
            self.out.append(block)
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.end()
        if tag in ("nav", "footer", "head") or dict(attrs).get("class") == "ad":
            self.skip.append(tag)

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.end()
        if self.skip and self.skip[-1] == tag:
            self.skip.pop()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def test_html_against_a_slow_extractor(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_consensus.extract(pages).collect()}
    wrong = []
    for r in pages.collect():
        slow = SlowExtractor()
        slow.feed(r["html"] or "")
        slow.close()
        slow.end()
        if got[r["page_id"]] != "\n".join(slow.out):
            wrong.append(r["page_id"])
    assert len(got) == pages.count() and not wrong


# ---- pieces


@pytest.fixture(scope="module")
def piece_model():
    return public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library(piece_model):
    library, coder = sentencepiece.SentencePieceProcessor(model_file=piece_model), piece_bpe.PieceCoder(piece_bpe.read_model(piece_model))
    rng = random.Random(1)
    letters = list("aAbe  n\n\t.,'  ▁éß中文字🙂́\x00<0x0A>▁▁ the in\r１２3 4")
    for k in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 40)))
        ids = library.encode(text, add_eos=True)
        assert coder.encode(text) == ids and coder.decode(ids) == library.decode(ids), repr(text)


def test_piece_digests(docs, piece_model):
    library, table = sentencepiece.SentencePieceProcessor(model_file=piece_model), piece_bpe.read_model(piece_model)
    got = {r["doc_id"]: r for r in piece_bpe.digests(docs, table).collect()}
    for k, text, *_ in corpus()[:60] + odd_rows():
        ids = library.encode(text or "", add_eos=True)
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert piece_bpe.digests(empty(docs), table).count() == 0
    both = piece_bpe.decode(piece_bpe.encode(docs.filter("doc_id < 20"), table), table)
    assert {r["doc_id"]: r["text"] for r in both.collect()} == {k: t for k, t, *_ in corpus()[:20]}


# ---- packing


def test_linear_program_reaches_the_bound():
    rng = np.random.default_rng(2)
    counts = np.bincount(rng.integers(1, 129, 5000), minlength=257)  # none over half: the sum of lengths is the bound
    weight = np.flatnonzero(counts)
    columns, times = packing.patterns(weight, counts[weight].astype(float), 256)
    assert (weight @ columns <= 256).all() and np.allclose(columns @ times, counts[weight])
    assert times.sum() <= (counts * np.arange(257)).sum() / 256 * 1.02


def check_packing(got: list, docs: list[tuple]) -> float:
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    for k, text, *_ in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        copies = sum(1 for d in docs if d[0] == k)
        assert sum(r["length"] for r in by_doc[k]) == copies * len(ids)
        for r in by_doc[k]:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    return 1 - sum(r["length"] for r in got) / (packing.CAPACITY * len(by_sequence))


def test_packing(docs):
    rows = corpus() + odd_rows()
    got = packing.pack(docs, queries.tokenizer_json()).collect()
    check_packing(got, rows)
    assert packing.pack(empty(docs), queries.tokenizer_json()).count() == 0


def test_packing_of_one_hot_length(spark):
    rows = [(k, "word " * 1100, "en", "s", 1) for k in range(60)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), queries.tokenizer_json()).collect()
    assert check_packing(got, rows) < 0.05


def test_word_ids_equal_the_tokenizer():
    tokenizer, words = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), packing.WordIds(queries.tokenizer_json())
    rng = random.Random(2)
    letters = [*"aAbe  n\n\t.,'  ▁éß中文字🙂́\x00'sΣς \x85\x1c\xa0İ１2", "<|endoftext|>", "<|startoftext|>", "'re", "Straße,", "ÉTÉ!", "x&&&"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 30)))
        assert words.encode(text.encode().split()) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


# ---- fingerprints


def test_fingerprints(docs):
    got = fingerprints.compare_with_next(docs).collect()
    rows = sorted(corpus() + odd_rows(), key=lambda r: (r[0], r[1] or ""))
    texts = [r[1] or "" for r in rows]
    want = {}
    for k, (row, text) in enumerate(zip(rows, texts, strict=True)):
        after = texts[(k + 1) % len(texts)]
        made = fingerprints.edited(text, after)
        own, again, other = (fingerprints.digest(t.encode()) for t in (text, made, after))
        want.setdefault(row[0], []).append((len(text), hashlib.sha256(made.encode()).hexdigest(), own, again, fingerprints.likeness(own, again), fingerprints.likeness(own, other)))
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert fingerprints.compare_with_next(empty(docs)).count() == 0
    one = fingerprints.compare_with_next(docs.filter("doc_id = 7")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_fingerprint_counts_against_plain_loops():
    data = b"hello fingerprint world"
    total = np.zeros(fingerprints.BUCKETS, int)
    padded = b"\0\0\0\0" + data
    for i in range(4, len(padded)):
        for salt, (x, y, z) in enumerate(fingerprints.TRIPLETS):
            a, b, c = fingerprints._FACTORS
            h = (padded[i - x] * a + padded[i - y] * b) & 0xFFFF
            h ^= h >> 5
            h = (h + padded[i - z] * c) & 0xFFFF
            h = h * fingerprints._SALTS[salt] & 0xFFFF
            h ^= h >> 8
            total[(h * 0x9E35 & 0xFFFF) >> 9] += 1
    assert (fingerprints.bucket_counts(data) == total).all()
    assert fingerprints.likeness(fingerprints.digest(data), fingerprints.digest(data)) == 1.0


# ---- n-gram join


def brute_classes(rows: list[tuple]) -> dict:
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for k, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    label = {k: k for k in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def near_copies(seed: int) -> list[tuple]:
    """Chains of edits, exact copies, a passage that many share, and texts at the very limit."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, k = [], 0
    passage = [word() for _ in range(60)]
    for _ in range(6):
        text = [word() for _ in range(rng.choice([4, 12, 60, 300]))]
        for _ in range(12):
            rows.append((k, " ".join(text), "en", "s", 1))
            k += 1
            for _ in range(rng.randrange(0, 3)):
                text = text[:]
                text[rng.randrange(len(text))] = word()
    for _ in range(40):
        body = [word() for _ in range(rng.choice([5, 20, 200]))]
        rows.append((k, " ".join(body[:3] + passage + body[3:]), "en", "s", 1))
        k += 1
    base = [f"x{i}" for i in range(184)]
    rows += [(k, " ".join(base), "en", "s", 1), (k + 1, " ".join(base[:164]), "en", "s", 1), (k + 2, " ".join(base[:148]), "en", "s", 1), (k + 3, " ".join(base[:147]).upper(), "en", "s", 1)]
    return rows


@pytest.mark.parametrize(("seed", "cell"), [(1, ngram_join.CELL), (2, 8)])
def test_ngram_join(spark, seed, cell):
    rows = near_copies(seed) + odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("component", F.lit("clash")).withColumn("id", F.lit("clash"))
    got = ngram_join.classes_of(df, cell=cell).collect()
    assert len(got) == len(rows) and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_classes(rows)


def test_ngram_join_of_a_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = ngram_join.classes_of(df).collect()
    assert len(got) == len(rows) and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_classes(rows)


def test_ngram_join_null_and_repeated_keys(spark):
    x, y, t, u = ("x x1 x2 x3 x4", "y y1 y2 y3 y4", " ".join(f"t{i}" for i in range(200)), " ".join(f"t{i}" for i in range(195)))
    rows = [(1, x), (5, x), (5, y), (9, y), (9, ""), (3, ""), (3, ""), (None, t), (20, u), (21, t), (21, t), (None, "z z1"), (None, "z z1"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__row", F.lit("clash"))
    got = sorted(map(tuple, ngram_join.classes_of(df).collect()), key=repr)
    want = [(1, 1, 1), (5, 1, 1), (5, 1, 1), (9, 1, 1), (9, 0, 1), (3, 0, 3), (3, 0, 3), (None, 196, 20), (20, 191, 20), (21, 196, 20), (21, 196, 20), (None, 1, None), (None, 1, None), (None, 0, None), (None, 0, None)]
    assert got == sorted(want, key=repr)
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, x), (3, ""), (20, u), (None, "z z1"), (None, None), (None, "")], key=repr)


def test_cells_meet_once(spark):
    """Each pair of a tile whose sizes allow a link meets in one cell and on sides that are compared."""
    rng = random.Random(5)
    sizes = {k: rng.randrange(1, 400) for k in range(120)}
    tiles = spark.createDataFrame([(7, len(sizes), k, n) for k, n in sizes.items()], "h long, sets long, id long, n long")
    met = Counter()
    cells: dict = {}
    for r in ngram_join._cells(tiles, 16).collect():
        cells.setdefault((r["band"], r["i"], r["j"]), []).append((r["id"], r["side"]))
    for (_, i, j), members in cells.items():
        for k, (a, x) in enumerate(members):
            for b, y in members[k + 1 :]:
                if x + y == 3 or i == j and x + y == 2:
                    met[min(a, b), max(a, b)] += 1
    allowed = {(a, b) for a in sizes for b in sizes if a < b and 100 * min(sizes[a], sizes[b]) >= 80 * max(sizes[a], sizes[b])}
    assert allowed <= set(met) and set(met.values()) == {1} and max(map(len, cells.values())) < len(sizes)


def test_places_of_linked_sets():
    """Two linked sets share SHARED n-grams at early enough places, in any order of all n-grams."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(2, 200))
        pool = rng.permutation(2 * n)
        a, b = set(pool[:n].tolist()), set(pool[int(rng.integers(0, n // 8 + 1)) : n + int(rng.integers(0, n // 8 + 1))].tolist())
        if a == b or 100 * len(a & b) < 80 * len(a | b):
            continue
        x, y = ({v: k for k, v in enumerate(sorted(members))} for members in (a, b))
        at, other = (np.array([places[v] for v in sorted(a & b)]) for places in (x, y))
        assert ngram_join.early_enough(np.int64(len(a)), at, np.int64(len(b)), other).sum() >= min(ngram_join.SHARED, len(a & b))


def test_ngram_join_of_nothing(docs):
    assert ngram_join.classes_of(empty(docs)).count() == 0
    none = ngram_join.classes_of(docs.filter("doc_id IN (1000, 1001, 1002)")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in none) == [(1000, 0, 1000), (1001, 0, 1001), (1002, 0, 1002)]
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns


def test_bitmap_bound_never_loses_a_pair():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 1 << 63, int(rng.integers(0, 60))).astype(np.uint64)]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        true = 100 * both >= 80 * (len(a) + len(b) - both)
        assert ngram_join.linked(a, b) == true
        assert (ngram_join.unpacked_array(ngram_join.packed_array(a)) >> np.uint64(24) == a >> np.uint64(24)).all()
        for wider in (1, ngram_join.WIDER):
            x, y = ngram_join.bitmap(a, wider), ngram_join.bitmap(b, wider)
            size = min(len(x), len(y))
            got = ngram_join.may_link(len(a), ngram_join.folded(x, size), np.array([len(b)]), ngram_join.folded(y, size)[None])[0]
            assert got or not true
