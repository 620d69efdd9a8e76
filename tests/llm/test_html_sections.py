"""Pages whose articles hold linked titles, lists of links, formulas, odd quotes and sections that are named like boilerplate."""

from __future__ import annotations

import pytest

from chronoweft.llm import html_consensus

TWO = "<p>The first paragraph of this article is long enough.</p><p>The second paragraph of it says some more.</p>"
TEXT = "The first paragraph of this article is long enough.\nThe second paragraph of it says some more."

SHAPES = {
    "linked title": (f"<h1><a href=/x>Linked title</a></h1><div class=body>{TWO}</div>", f"Linked title\n{TEXT}"),
    "cited links": (f"<div class=body>{TWO}</div><ul><li><a href=/1>A cited work</a></li><li><a href=/2>Another one</a></li></ul>", f"{TEXT}\nA cited work\nAnother one"),
    "one word": (f"<div class=body>{TWO}</div><div>Yes</div>", f"{TEXT}\nYes"),
    "related work": (f"{TWO}<div class='related-work'><p>Others have written on this in {{0}} other ways.</p></div>", f"{TEXT}\nOthers have written on this in {{0}} other ways."),
    "discussion": (f"{TWO}<section id=discussion><h2>Discussion</h2><p>What {{0}} findings mean for us.</p></section>", f"{TEXT}\nDiscussion\nWhat {{0}} findings mean for us."),
    "alert": (f"{TWO}<div class=alert><p>Mind the {{0}} steps on the way up.</p></div>", f"{TEXT}\nMind the {{0}} steps on the way up."),
    "formula": (f"{TWO}<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=tex>x=2</annotation></math> holds.</p>", f"{TEXT}\nSo x=2 holds."),
    "odd quote": (f'{TWO}<script src="x>var a=1;</script><style media=\'y>p{{{{}}}}</style><p>After the script.</p>', f"{TEXT}\nAfter the script."),
}
NAV = "<nav><ul><li><a href=/>Home page</a></li></ul></nav>"


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_shapes(shape):
    inner, expected = (x.format(7) for x in SHAPES[shape])
    page = html_consensus.read(f"<html><body>{NAV}<article>{inner}</article><footer>foot of all</footer></body></html>")
    assert page.extract(page.best()[0][0]) == expected


def test_shapes_over_hosts(spark):
    """Each host has pages of one shape; sections are no boilerplate, as their texts differ."""
    rows, expected = [], {}
    for n, (inner, text) in enumerate(SHAPES.values()):
        for k in range(5):
            rows.append((10 * n + k, f"http://h{n}.example.com/{k}", f"<html><body>{NAV}<article>{inner.format(k)}</article><footer>foot of all</footer></body></html>"))
            expected[10 * n + k] = text.format(k)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("repeated", html_consensus.F.lit("clash"))
    assert {r.page_id: r.text for r in html_consensus.extract(df).collect()} == expected


def test_repeated_sections_and_lists_of_links_go(spark):
    """A notice with one text on most pages of a host goes, also from a page whose own notice differs; one on two pages stays, as on copies of one page."""
    article = lambda part, k=0: f"<body><article>{TWO}<p>Of page {k}.</p>{part}</article></body>"
    notice = "<div class=notice><p>This site was made by us.</p></div>"
    rows = [(k, f"http://a/{k}", article(notice, k)) for k in range(5)] + [(5, "http://a/5", article("<div class=notice><p>Another notice.</p></div>", 5))]
    rows += [(k, f"http://b/{k}", article(notice)) for k in range(10, 15)] + [(k, f"http://c/{k}", article(notice, k)) for k in (20, 21)]
    rows += [(30, "http://d/", article("<div class=related><ul><li><a href=/1>Other story</a></li><li><a href=/2>One more</a></li></ul></div>"))]
    rows += [(40, None, article(notice)), (41, "http://e/", article("<div class=comments><p>A reader says something here.</p></div>"))]
    got = {r.page_id: r.text for r in html_consensus.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = lambda k: f"{TEXT}\nOf page {k}."
    assert all(got[k] == own(k) for k in range(6))
    assert all(got[k] == own(0) + "\nThis site was made by us." for k in (*range(10, 15), 40)) and all(got[k] == own(k) + "\nThis site was made by us." for k in (20, 21))
    assert got[30] == own(0) and got[41] == own(0)


def test_null_page_ids(spark):
    rows = [(None, "http://a/1", f"<article>{TWO}</article>"), (None, None, None), (1, "http://a/1", "")]
    got = [(r.page_id, r.text) for r in html_consensus.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got, key=repr) == [(1, ""), (None, ""), (None, TEXT)]


def test_raw_elements():
    text = lambda page: "\n".join(b.text for b in html_consensus.read(page).blocks)
    assert text("<p>one <svg width=1/> two</p>") == "one two" and text("<p>a</p><script>never <b>ends") == "a"
    assert text("<p>x<titlebar>y</titlebar></p>") == "xy" and text('<script data-x="a>b">c</script><p>d</p>') == "d"
