"""HTML extraction by consensus host paths.

Boilerplate is what stands in elements, roles or classes of that kind. A class or id counts by its whole tokens: `site-footer`
and `comments` name boilerplate, `no-sidebar`, `has-footer` and `overflow-hidden` say how a page is laid out. A container with
such a class is still none if it holds `main` or nearly all of the page's text. In a `header` within an article or `main` the
headings are content. Where a page has text in boilerplate of classes only, that is its content. Within an article or `main` some names of
boilerplate are names of sections too (`related-work`, `discussion`, `alert`): such a part goes if it is mostly links, or if most pages of the host that have it, copies
of a page apart, repeat its text, which is counted in Spark.

The content of a page is its headings in an article or `main`, and its blocks outside boilerplate that are neither mostly links nor labels (a single short
word that stands in no paragraph, heading, list or table); without any, its other blocks, those of links last. Each page votes, in Spark, for the innermost container
that holds all of its content, or the article around that one, and with smaller shares for those around it, as paths for their host: tags and classes
from the root down, with digits generalised. Each page is then extracted again with the winning path of its host: all
blocks in there, links and labels too, and content wherever else it stands on the page. A page without that path, or
without text there, uses its own container.

The markup is read leniently: unclosed and misnested elements, comments and scripts without an end, attributes with
or without quotes; an odd quote in the tag of a script or style doesn't let its text out. Formulas are text, but for their annotations; what stands
in `object` or `iframe` for browsers without it isn't. Blocks end at block elements and at line breaks; character references are decoded after markup
is taken out; white space in a block becomes one space; empty blocks go; blocks are joined by one line feed.

Cases: a null or empty page gives an empty text. A page without a host (null url, or one without `//`) votes with
the others of that kind. Ties between paths go to the one that sorts first. Repeated rows each vote and each have a
result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import map_batches, materialize

#: So many hosts' winning paths and repeated sections together may be broadcast; a path has at most _PATH_LABELS labels of _LABEL_BYTES characters and a digest.
BROADCAST_HOSTS = 50_000
_PATH_LABELS = 8
_LABEL_BYTES = 100
#: Containers with a class of boilerplate hold this share of a page's text only if they are around the article too.
_NEARLY_ALL = 0.8
SALTS = 16
_MOST_VOTES = 3

# Element and class names of HTML pages.
_RAW = "script|style|title|noscript|textarea|template|svg|annotation|annotation-xml|iframe|object|select|canvas"
_CONTAINERS = frozenset("html body main article section div table tbody tr td th ul ol li dl dd dt nav header footer aside form figure figcaption blockquote details dialog menu fieldset head button label".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre br hr address summary caption thead tfoot center option legend".split())
_DROPPED = frozenset("nav header footer aside form head button menu dialog label fieldset".split())
#: First parts of class names that say how a page is laid out, and words of _BOILERPLATE that count only as whole names.
_LAYOUT = frozenset("no not has with without is hide show toggle overflow col row grid".split())
_WHOLE_ONLY = frozenset("hidden side rail reply skip search foot tags legal social".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs header masthead footer foot copyright cookie cookies consent gdpr notice notices alert"
    " popup modal overlay newsletter subscribe subscription signup login paywall comment comments commentlist reply replies respond discussion disqus related recommended recommendations share sharing social widget toolbar pagination pager tags skip hidden"
    " search legal disclaimer toc".split()
)
#: A single word of so many characters at most, right in one of these elements, is a label.
_LABEL_CHARS = 20
_PLAIN = frozenset(["", "html", "body", "div", "section"])
#: Words of _BOILERPLATE that name sections of articles too.
_SECTIONS = frozenset("related recommended recommendations discussion alert notice notices legal disclaimer toc tags side header banner search skip copyright overlay hidden rail foot".split())
#: A part counts as repeated from so many different pages of a host on.
_LEAST_PAGES = 3
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<svg\b[^<>]*/>|<(?P<raw>{_RAW})(?![\w-]).*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[^a-z]+")
_DIGITS = re.compile(r"\d+")


@dataclass
class Container:
    """label: tag and classes. digest: of the labels from the root down to here. kind: 3 boilerplate or section of an article, 2 boilerplate, 1 by class only, 0 none."""

    label: str
    digest: int
    parent: int
    kind: int
    main: bool = False


@dataclass
class Block:
    at: int
    text: str
    content: bool
    linked: bool
    heading: bool


@dataclass
class Page:
    """The containers of a page in page order, and its blocks with their innermost container; boilerplate too until settled."""

    containers: list[Container] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    sections: list[int] = field(default_factory=list)

    def path(self, at: int) -> str:
        """Name of a container's path: a digest of all labels and the last few of them."""
        labels, k = [], at
        while k > 0 and len(labels) < _PATH_LABELS:
            labels.append(self.containers[k].label[:_LABEL_BYTES])
            k = self.containers[k].parent
        return f"{'/'.join(reversed(labels))}#{self.containers[at].digest:016x}"

    def totals(self, of: list[int]) -> list[int]:
        """`of` by container, with what is in the containers inside."""
        for k in range(len(of) - 1, 0, -1):
            of[self.containers[k].parent] += of[k]
        return of

    def settle(self) -> None:
        """Decides which containers are boilerplate and leaves out their blocks."""
        held, mains = [0] * len(self.containers), [0] * len(self.containers)
        hard = self.below(lambda c: c.kind == 2)
        for b in self.blocks:
            held[b.at] += len(b.text) * (not hard[b.at] and not b.linked)
        for k, linked in self.linked_share().items():
            if linked > 0.5:
                self.containers[k].kind = 2
            else:
                self.containers[k].kind = 0
                self.sections.append(k)
        for k, c in enumerate(self.containers):
            mains[k] += c.main
        held, mains = self.totals(held), self.totals(mains)
        for k, c in enumerate(self.containers):
            if c.kind == 1 and (mains[k] or held[k] > _NEARLY_ALL * held[0]):
                c.kind = 0
        bad = self.below(lambda c: c.kind > 0)
        kept = [b for b in self.blocks if not bad[b.at] or b.heading and not self.outside_article(b.at)]
        self.blocks = kept or [b for b in self.blocks if not hard[b.at]]

    def linked_share(self) -> dict[int, float]:
        """Of each part that may be boilerplate or a section: the share of its text that stands in blocks of links."""
        if all(c.kind != 3 for c in self.containers):
            return {}
        text, linked = [0] * len(self.containers), [0] * len(self.containers)
        for b in self.blocks:
            text[b.at] += len(b.text)
            linked[b.at] += len(b.text) * b.linked
        text, linked = self.totals(text), self.totals(linked)
        return {k: linked[k] / max(text[k], 1) for k, c in enumerate(self.containers) if c.kind == 3}

    def section_texts(self) -> list[tuple[int, int]]:
        """(digest of the path, digest of the text) of the sections named like boilerplate."""
        out = []
        for k in self.sections:
            inside = self.below(lambda c, own=self.containers[k]: c is own)
            out.append((self.containers[k].digest, xxhash.xxh3_64_intdigest("\n".join(b.text for b in self.blocks if inside[b.at]).encode("utf-8", "replace"))))
        return out

    def below(self, is_one) -> list[bool]:
        """By container: whether it or one around it is such a one."""
        out: list[bool] = []
        for c in self.containers:
            out.append(is_one(c) or c.parent >= 0 and out[c.parent])
        return out

    def outside_article(self, at: int) -> bool:
        """Whether a container isn't, by no other boilerplate than `header` elements, in an article or main."""
        while at > 0:
            c = self.containers[at]
            tag = c.label.split(".", 1)[0]
            if c.kind == 0 and tag in ("article", "main"):
                return False
            if c.kind and tag != "header":
                return True
            at = c.parent
        return True

    def best(self) -> list[tuple[str, float]]:
        """Paths with their shares: the innermost container that leaves no content behind, and those around it. A page without content goes by its labels, or by its links."""
        counted = [b.at for b in self.blocks if b.content] or [b.at for b in self.blocks if not b.linked] or [b.at for b in self.blocks]
        if not counted:
            return []
        total = [0] * len(self.containers)
        for at in counted:
            total[at] += 1
        total = self.totals(total)
        at = max(k for k, n in enumerate(total) if n == total[0])
        around = at
        while around > 0 and self.containers[around].label.split(".", 1)[0] != "article":
            around = self.containers[around].parent
        at, line = around if around > 0 else at, []
        while at >= 0 and len(line) < _MOST_VOTES:
            line.append(at)
            at = self.containers[at].parent
        return [(self.path(k), 1.0 / (1 + n)) for n, k in enumerate(line)]

    def extract(self, path: str | None, repeated: frozenset[int] = frozenset()) -> str:
        """All blocks below the path and the content beside it, without the sections whose paths the host repeats; empty if the page has no text below the path."""
        digest = int(path.rsplit("#", 1)[1], 16) if path else None
        inside = self.below(lambda c: c.digest == digest)
        gone = {k for k in self.sections if self.containers[k].digest in repeated}
        out = self.below(lambda c: any(c is self.containers[k] for k in gone)) if gone else [False] * len(self.containers)
        here = [inside[b.at] for b in self.blocks]
        return "\n".join(b.text for b, within in zip(self.blocks, here, strict=True) if (within or b.content) and not out[b.at]) if any(here) else ""


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if rest.strip(" /") else {}


def _of_boilerplate(name: str) -> int:
    """Whether a class or id names boilerplate: by its first or last part, unless the first says how the page is laid out; 1 if that may also name a section, else 2."""
    parts = [p for p in _PARTS.split(name) if p]
    if not parts or parts[0] in _LAYOUT:
        return 0
    found = [parts[0]] if len(parts) == 1 and parts[0] in _BOILERPLATE else [p for p in (parts[0], parts[-1]) if p in _BOILERPLATE and p not in _WHOLE_ONLY]
    return max((1 if p in _SECTIONS else 2 for p in found), default=0)


def read(page: str | None) -> Page:
    """The containers and blocks of a page, boilerplate left out."""
    out = Page([Container("", 0, -1, 0)])
    stack = [(0, "")]
    open_tags: Counter[str] = Counter()
    text: list[str] = []
    linked = 0
    in_link = named = heading = False  # named: in a paragraph, heading or the like

    def end_block() -> None:
        nonlocal linked
        if text:
            at = stack[-1][0]
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                links = 2 * linked >= len(whole)
                label = not named and stack[-1][1] in _PLAIN and len(whole) <= _LABEL_CHARS and whole.isascii() and " " not in whole
                out.blocks.append(Block(at, whole, not links and not label or heading and bool(open_tags["article"] or open_tags["main"]), links, heading))
            text.clear()
        linked = 0

    def add(part: str) -> None:
        nonlocal linked
        if part:
            text.append(part)
            if in_link:
                linked += len(part)

    def close(tag: str) -> None:
        if open_tags[tag]:
            while (last := stack.pop()[1]) != tag:
                open_tags[last] -= 1
            open_tags[tag] -= 1

    page, done = page or "", 0
    for m in _TOKEN.finditer(page):
        add(page[done : m.start()])
        done = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not m["close"]
            continue
        if tag not in _BLOCKS:
            continue
        end_block()
        if tag not in ("br", "hr"):
            named = tag not in _CONTAINERS and not m["close"]
            heading = tag in _HEADINGS and not m["close"]
        if tag not in _CONTAINERS:
            continue
        if m["close"]:
            if open_tags[tag]:
                close(tag)
                in_link = False
            continue
        if tag in ("li", "td", "th", "tr", "dd", "dt") and stack[-1][1] == tag:
            close(tag)
        if tag == "body" and stack[-1][1] == "head":
            close("head")
        names = _attributes(m["rest"])
        classes = names.get("class", "").lower().split()
        parent = stack[-1][0]
        hard = tag in _DROPPED or names.get("role", "").lower() in _ROLES or "hidden" in names or names.get("aria-hidden") == "true"
        soft = max(map(_of_boilerplate, [*classes, names.get("id", "").lower()])) if tag not in ("html", "body", "main", "article") else 0
        label = ".".join([tag, *sorted({_DIGITS.sub("0", c) for c in classes})])
        digest = xxhash.xxh3_64_intdigest(label.encode("utf-8", "replace"), seed=out.containers[parent].digest)
        out.containers.append(Container(label, digest, parent, 2 if hard else 3 if soft == 1 and (open_tags["article"] or open_tags["main"]) else int(soft > 0), tag == "main"))
        stack.append((len(out.containers) - 1, tag))
        open_tags[tag] += 1
    add(page[done:])
    end_block()
    out.settle()
    return out


def host_of(url: Column) -> Column:
    """The host in lower case, without port; null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def _votes(pages: DataFrame, url: str, markup: str) -> DataFrame:
    """host, with path and votes of its pages, or with part, content and page: a section named like boilerplate, the digests of its text and of the page's."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(markup).alias("html"))

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            votes: dict[tuple, float] = {}
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                parsed = read(page.as_py())
                for path, share in parsed.best():
                    k = host, path, None, None, None
                    votes[k] = votes.get(k, 0.0) + share
                if parsed.sections:
                    whole = xxhash.xxh3_64_intdigest("\n".join(b.text for b in parsed.blocks).encode("utf-8", "replace"))
                    votes.update(((host, None, *(x - (1 << 63) for x in (digest, content, whole))), 0.0) for digest, content in parsed.section_texts())
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([*(pa.array([k[n] for k in votes], kind) for n, kind in enumerate(kinds)), pa.array(votes.values(), pa.float64())], ["host", "path", "part", "content", "page", "votes"])

        return one

    return map_batches(rows, make, "host string, path string, part long, content long, page long, votes double")


def host_paths(pages: DataFrame, url: str = "url", markup: str = "html") -> DataFrame:
    """(host, path, repeated): the path with most votes of each host, and the sections whose text most of its pages repeat, as a list."""
    votes = materialize(_votes(pages, url, markup).groupBy("host", "path", "part", "content", "page").agg(F.sum("votes").alias("votes")), "html-votes")
    best = votes.filter("part IS NULL").groupBy("host", "path").agg(F.sum("votes").alias("votes")).groupBy("host").agg(F.min(F.struct((-F.round("votes", 6)).alias("votes"), "path")).alias("best"))
    texts = votes.filter("part IS NOT NULL").groupBy("host", "part", "content").count().groupBy("host", "part").agg(F.sum("count").alias("pages"), F.count("*").alias("texts"))
    repeated = texts.filter((F.col("pages") >= _LEAST_PAGES) & (2 * F.col("texts") <= F.col("pages"))).groupBy(F.col("host").alias("of")).agg(F.sort_array(F.collect_list("part")).alias("repeated"))
    return best.join(repeated, F.col("host").eqNullSafe(F.col("of")), "left").select("host", F.col("best.path").alias("path"), F.coalesce("repeated", F.array().cast("array<long>")).alias("repeated"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """(key, url, text) of every row of pages."""
    paths = materialize(host_paths(pages, url, markup), "html-paths")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(markup).alias("html"), F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"))
    paths = paths.select(F.coalesce("host", F.lit("")).alias("host"), "path", "repeated")
    if (paths.agg(F.sum(1 + F.size("repeated"))).first()[0] or 0) <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(paths), "host", "left")
    else:  # hosts differ much in size: each one's path goes to several places
        salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = []
            for page, path, parts in zip(batch.column("html"), batch.column("path").to_pylist(), batch.column("repeated").to_pylist(), strict=True):
                parsed, repeated = read(page.as_py()), frozenset(x + (1 << 63) for x in parts or ())
                found = parsed.extract(path, repeated)
                if not found:
                    own = parsed.best()
                    found = parsed.extract(own[0][0], repeated) if own else ""
                texts.append(found)
            return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string())], [key, "url", "text"])

        return one

    return map_batches(joined.select("key", "url", "html", "path", "repeated"), make, f"`{key}` {rows.schema['key'].dataType.simpleString()}, url string, text string")
