from __future__ import annotations

import time

import numpy as np
import pytest

from pulltally.llm import html_text
from pulltally.llm.html_text import Dom, decode, describe, main_text

SENTENCES = [f"Sentence number {k}, with some words, of an ordinary length; it ends here." for k in range(50)]


def page(k: int, article: str = "article") -> tuple[str, str]:
    body = [f"Title &amp; {k}", *SENTENCES[k % 10:k % 10 + 3 + k % 5]]
    want = "\n".join([f"Title & {k}", *body[1:]])
    inner = f"<h1>{body[0]}</h1>" + "".join(f"<p>{s}</p>" for s in body[1:])
    links = "".join(f'<li><a href="/{j}">Link {j}</a></li>' for j in range(6))
    return (
        f"<!DOCTYPE html><html><head><title>T {k}</title><style>p{{margin:0}}</style></head><body><nav><ul>{links}</ul></nav>"
        f'<div class="cookie-notice">We use cookies, and more.</div><aside class="sidebar"><p>Elsewhere, we wrote of other things.</p></aside>'
        f"<{article}>{inner}</{article.split()[0]}>"
        f'<div id="comments"><p>A reader, who disagrees with this.</p></div><form><label>Name</label><input></form><footer>&copy; {k}</footer></body></html>',
        want,
    )


@pytest.fixture(scope="module")
def trees(spark):
    rows = [(k, "u", page(k)[0]) for k in range(60)]
    return html_text.fit(spark.createDataFrame(rows, "page_id long, url string, html string"))


def texts(spark, trees, pages):
    table = spark.createDataFrame([(k, "u", h, "x") for k, h in enumerate(pages)], "page_id long, url string, html string, text string")
    return [r["text"] for r in html_text.extract_text(table, trees).orderBy("page_id").collect()]


def test_articles(spark, trees):
    pages = [page(100 + k) for k in range(20)]
    assert texts(spark, trees, [h for h, _ in pages]) == [w for _, w in pages]


def test_article_named_by_a_class(spark, trees):
    html, want = page(3, 'div class="post-body entry"')
    assert texts(spark, trees, [html.replace("<div class", "<div class", 1)]) == [want]


def test_odd_pages(spark, trees):
    rows = [None, "", "   ", "<", "</p></div>", "<script>alert('<p>x</p>')</script>", "<article><p>One\n  two<br>three<p>Four &lt;five&gt; &eacute;</article>", "<article>" + "<div>" * 3000 + "<p>Deep text, in a page of many layers.</p>", "<article><p>Cut off text, as it is.</p><di"]
    found = texts(spark, trees, rows)
    assert found[:6] == ["", "", "", "<", "", ""] or found[:6] == [""] * 6
    assert found[6] == "One two three\nFour <five> é"
    assert found[7] == "Deep text, in a page of many layers." and found[8] == "Cut off text, as it is."


def test_without_anything_to_learn_from(spark):
    assert html_text.fit(spark.createDataFrame([], "page_id long, url string, html string")) is None
    plain = spark.createDataFrame([(None, None, "<p>Text of a page, without any name.</p>"), (1, "u", None)], "page_id long, url string, html string")
    assert html_text.fit(plain) is None
    assert sorted(r["text"] for r in html_text.extract_text(plain, None).collect()) == ["", "Text of a page, without any name."]


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = 9
        parent = np.array([-1, *(rng.integers(0, k) for k in range(1, n))])
        gain = rng.normal(size=n)
        gain[0] = 1e-9
        best = max(
            sum(gain[i] for i in range(n) if kept >> i & 1)
            for kept in range(1, 1 << n, 2)
            if all(not kept >> i & 1 or kept >> int(parent[i]) & 1 for i in range(1, n))
        )
        kept = decode(parent, gain)
        assert all(not kept[i] or kept[parent[i]] for i in range(1, n))
        assert gain[kept].sum() == pytest.approx(max(best, 1e-9))


def test_dom():
    dom = Dom.of("<div>a<p>b<p>c<b>d</div>e<ul><li>f<li>g</ul><img>h")
    assert main_text(dom, np.ones(len(dom.tag), bool)) == "a\nb\ncd\ne\nf\ng\nh"
    features, label = describe(dom)
    assert features.shape == (len(dom.tag), len(html_text.FEATURES)) and np.isfinite(features).all() and (label == -1).all()


@pytest.mark.parametrize("unit", ["<a ", "<a x='", "<div>", "</b>", "<!--", "<b><p>", "<table><p>", "<![x ", "<a b=\"", "&#x", "<script>"])
def test_broken_pages_take_linear_time(unit):
    """Half a megabyte of unfinished tags, comments, attributes and nesting."""
    for end in ("", "> <p>end</p>"):
        start = time.process_time()
        dom = Dom.of("<p>start</p>" + unit * (500_000 // len(unit)) + end)
        html_text.decode(np.array(dom.parent), html_text._gains(dom, html_text.describe(dom)[0], None))
        assert time.process_time() - start < 20
        assert dom.pieces[0][2] == "start"


def test_text_after_broken_markup():
    def text(html):
        return " ".join(t for _, _, t in Dom.of(html).pieces)

    assert text("<p>a < b</p> tail <a <b x='") .split() == "a < b tail".split()
    assert text("<p>one</p><!-- two <p>three</p>") == "one"
    assert text("<p>one</p><![CDATA[ two ]]><p>three</p>") == "one three"
    dom = Dom.of("<div><p>a<div>b</b></div>c</p>d</div>e")
    assert [dom.tag[node] for _, node, _ in dom.pieces] == ["p", "div", "div", "div", "#page"]
