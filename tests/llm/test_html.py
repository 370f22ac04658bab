"""The text of pages with each kind of region inside the article, on seeds that are not trained on."""

import html
import re
import time

import pytest

from amplispark.llm import html_pages, html_text

PAGES = 150


def shown(x):
    x = re.sub(r"<button>.*?</button>|<input[^>]*>", "", x)
    return [" ".join(html.unescape(y).split()) for y in re.split(r"<[^>]*>", x) if y.strip()]


@pytest.mark.parametrize("kind", ["advert", "notice", "sidebar", "form", "comments"])
def test_regions_inside_an_article_go(kind):
    left = 0
    for k in range(PAGES):
        w = html_pages._Writer(91_000_000 + k)
        paragraphs = [f"<p>{w.paragraph()}</p>" for _ in range(w.rng.randint(2, 8))]
        piece, at = getattr(w, kind)(), w.rng.randint(1, len(paragraphs) - 1)
        page = f"<html><head><title>x</title></head><body>{w.menu()}<article><h1>{w.words(2, 6)}</h1>{''.join(paragraphs[:at])}{piece}{''.join(paragraphs[at:])}</article>{w.footer()}</body></html>"
        got = html_text.main_text(page.replace(' data-content="0"', ""), html_text.trained()).split("\n")
        assert [x for p in paragraphs for x in shown(p)] == [x for x in got if x in {y for p in paragraphs for y in shown(p)}]
        left += any(x in got for x in shown(piece) if len(x) > 3)
    assert left <= 0.04 * PAGES


def test_the_gradient_is_that_of_the_likelihood():
    """Marginals of a forest, by levels, are those of its trees one by one."""
    import numpy as np

    nodes = html_text.parse("<div><p>a</p><ul><li>b<li>c</ul></div><p>d</p>")[0]
    rng = np.random.default_rng(3)
    own, pair = rng.normal(size=len(nodes)), rng.normal(size=(2, 2))
    depth = [0] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        depth[i] = depth[n.parent] + 1
    levels = [np.flatnonzero(np.array(depth) == d) for d in range(max(depth) + 1)]
    p, joint = html_text.forest_marginals(np.array([max(0, n.parent) for n in nodes]), levels, own, pair)
    assert np.allclose(p, html_text.marginals(nodes, own.tolist(), pair.tolist())) and joint.sum() == pytest.approx(len(nodes) - 1)


def test_malformed_pages_take_linear_time():
    start = time.perf_counter()
    html_text.main_text("<div>" * 20_000 + "</p></b>" * 20_000 + "x" + "</i></div>" * 20_000, html_text.trained())
    html_text.main_text("<b>" * 20_000 + "<h1>" * 20_000, html_text.trained())
    assert time.perf_counter() - start < 60


def test_rows(spark):
    page = "<html><body><nav><ul><li><a href='/a'>Home page</a></li></ul></nav><article><h1>A title</h1><p>Some text, long enough. It goes on, and on.</p></article></body></html>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "Plain words, no markup at all. More of them, and more.", "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id int, url string, html string, text string")).collect()
    want = "A title\nSome text, long enough. It goes on, and on."
    assert [(r.page_id, r.url) for r in got] == [r[:2] for r in rows] and got[0].text == got[1].text == want and got[0].n_chars == len(want)
    assert [r.text for r in got[2:4]] == ["", ""] and isinstance(got[4].text, str)
    assert html_text.extract(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0


FIRST = "The council met on Tuesday, and after a long debate it agreed to build the bridge. Work begins in spring."
SECOND = "Costs are put at four million, half of which the state will pay. Two firms have offered, and a third may."
THIRD = "Residents had asked for a crossing for years, as the old ferry no longer runs. It will be open by autumn."
LINKS = '<a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sports</a> <a href="/c">Contact</a>'
#: Bodies that training has no layout or name of, written by hand, with the article in three stretches.
LAYOUTS = {
    "divs beside a nav": f"<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav><div>{FIRST}</div><div>{SECOND}</div><div>{THIRD}</div><footer>Imprint</footer>",
    "divs alone": f"<div>{LINKS}</div><div>{FIRST}</div><div>{SECOND}</div><div>{THIRD}</div><div>Copyright 2020 Example</div>",
    "paragraphs in divs": f"<div>{LINKS}</div><div><p>{FIRST}</p></div><div><p>{SECOND}</p><p>{THIRD}</p></div><p>&copy; Example</p>",
    "one cell": f"<table><tr><td>Home News</td><td><p>{FIRST}</p><p>{SECOND}</p><p>{THIRD}</p></td></tr></table>",
    "cells and a foot": f"<table border=0><tr><td colspan=2>The Daily</td></tr><tr><td>{LINKS}</td><td><p>{FIRST}<p>{SECOND}<p>{THIRD}</td></tr><tr><td>&copy; The Daily</td></tr></table>",
    "nested divs": f"<div class=x1><div>{LINKS}</div><div class=x2><div class=x3><p>{FIRST}</p><p>{SECOND}</p></div><div><p>{THIRD}</p></div></div></div>",
    "bare paragraphs": f"<p>{LINKS}</p><h1>Bridge</h1><p>{FIRST}</p><p>{SECOND}</p><p>{THIRD}</p><p>&copy; 2020</p>",
    "main with sections": f"<header><div>The Daily</div></header><main><section><h2>One</h2><p>{FIRST}</p></section><section><h2>Two</h2><p>{SECOND}</p><p>{THIRD}</p></section></main><footer>{LINKS}</footer>",
}
#: Names of regions that no generated page has.
UNSEEN = [
    '<div class="adpanel3">{}</div>', '<div id="adblock-top">{}</div>', '<aside class="advertorial">{}</aside>', '<div class="sponsoredpost">{}</div>', '<div id="bannerwide">{}</div>', '<div class="promobox">{}</div>',
    '<div class="cookiewall">{}</div>', '<div id="consentmanager">{}</div>', '<div class="newsletterform">{}</div>', '<section class="subscribenow">{}</section>', '<div id="disqusthread">{}</div>', '<section id="commentsblock">{}</section>',
    '<div class="commentary-list comments-3">{}</div>', '<div class="relatedstories">{}</div>', '<div class="sharethis">{}</div>', '<div class="sidebarleft">{}</div>', '<div class="widgetarea">{}</div>',
]


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts_that_are_not_trained_on(name):
    got = html_text.main_text(f"<html><head><title>t</title></head><body>{LAYOUTS[name]}</body></html>", html_text.trained())
    assert [x for x in got.split("\n") if x in (FIRST, SECOND, THIRD)] == [FIRST, SECOND, THIRD]
    assert not any(x in got for x in ("Home", "Copyright", "Imprint", "The Daily", "©"))


def test_names_that_are_not_trained_on():
    """Few regions of unseen names stay, and no article loses a stretch."""
    left, said = 0, "Buy our new shoes today, they are cheap. Only this week."
    outer = ("<article>{}</article>", '<div id="content">{}</div>', "<main>{}</main>", "<div>{}</div>")
    for box in outer:
        for region in UNSEEN:
            inner = f"<h1>Bridge agreed</h1><p>{FIRST}</p>{region.format(said)}<p>{SECOND}</p><p>{THIRD}</p>"
            got = html_text.main_text(f"<html><body><nav>{LINKS}</nav>{box.format(inner)}<footer>Imprint and contact</footer></body></html>", html_text.trained())
            assert all(x in got for x in ("Bridge agreed", FIRST, SECOND, THIRD)), (box, region)
            left += said in got
    assert left <= 0.1 * len(UNSEEN) * len(outer)
