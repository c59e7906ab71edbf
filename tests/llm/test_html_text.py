"""HTML extraction: exact marginals, held-out labelled pages, the given pages, edge cases."""

import html
import itertools
import re

import numpy as np

from tessella.llm.html_text import CONTENT, FURNITURE, Forest, default_model, extract_text, observe, training_pages

SF = "/root/testdata/sf0.01"


def test_messages_give_exact_marginals():
    model, forest = default_model(), Forest()
    forest.parse(0, "<body><nav><a href=x>go</a></nav><article><p>Some text, here.</article>")
    n = len(forest.parent)
    assert n <= 9
    seen = observe(forest)
    local = sum(u[seen[:, f]] for f, u in enumerate(model.unary))
    total = np.zeros((n, 3))
    for states in itertools.product(range(3), repeat=n):
        score = sum(local[i, s] for i, s in enumerate(states))
        score += sum(model.root[s] if p < 0 else model.edge[states[p], s] for p, s in zip(forest.parent, states))
        for i, s in enumerate(states):
            total[i, s] += np.exp(score)
    assert np.allclose(total / total.sum(axis=1, keepdims=True), model.marginals(forest))


def test_held_out_labelled_pages():
    model, forest = default_model(), Forest()
    for i, page in enumerate(training_pages(200, seed=5)):
        forest.parse(i, page, labelled=True)
    got = model.marginals(forest).argmax(axis=1)
    label = np.array(forest.label)
    runs = np.array([t is not None for t in forest.text]) & np.isin(label, (FURNITURE, CONTENT))
    assert ((got == label) | ~runs).sum() - (~runs).sum() > 0.93 * runs.sum()


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in extract_text(pages).collect():
        article = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><div class="cookie-notice"><p>We use cookies.</p></div>
<nav class=menu><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav><main><article><h1>A &amp; B</h1>
<p>First   paragraph with <b>bold</b> words,
and more of them.<br>After a break it goes on, and on.<script>if (a < b) { x() }</script><p>Second &eacute; one; it is <i>longer</i> than the first.
<ul><li>An item in a list.<li>Another item, too.</ul><form class="newsletter"><label>Mail</label><input><button>Go</button></form></article></main>
<aside class="sidebar"><h3>More</h3><p>Other <a href=/o>things</a></p></aside><section id="comments"><h3>Comments</h3><div class="comment"><b>Al</b><p>I liked it, really. It was good.</p></div></section>
<footer>&copy; site</footer></body></html>"""


def test_a_full_page_and_edge_cases(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "u", ""), (3, "u", "<p>" * 3000 + "deep"), (4, "u", "<script>never ends"), (5, "u", "<div class='a>b'><"), (6, "u", "<nav><a>x</a></nav>")]
    out = [r for r in extract_text(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()]
    assert out[0] == out[1]
    assert out[0].text.split("\n") == [
        "A & B", "First paragraph with bold words, and more of them. After a break it goes on, and on.", "Second é one; it is longer than the first.", "An item in a list.", "Another item, too.",
    ]
    assert [r.text for r in out[2:4]] == ["", ""] and out[5].text == "" and out[7].text == "" and len(out) == len(rows)
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_graphics_and_controls_do_not_swallow_text():
    para = "<p>A paragraph of the article, with several words. It goes on, and it ends here.</p>"
    page = lambda x: f"<html><body><main><article>{para}{x}{para.replace('A para', 'B para')}</article></main></body></html>"
    odd = ["<svg width=1 height='2'/>", "<math/>", "<p>Text <select><option>x</p>", "<object data=x>", "<canvas id=c>"]
    for x, text in zip(odd, default_model().extract([page(x) for x in odd]), strict=True):
        assert "A paragraph" in text and "B paragraph" in text, x
    forest = Forest()
    forest.parse(0, page("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math>, it is said.<noscript>fallback</noscript></p>"))
    assert {"x", "=", "1", "fallback"} <= set(forest.text)


def test_deep_pages_take_linear_time():
    """Stray end tags in deep trees, and a paragraph that a block far below its start ends."""
    import time

    deep = "<div>" * 6000 + "</span></i></p>" * 6000
    began = time.process_time()
    Forest().parse(0, deep)
    assert time.process_time() - began < 3
    forest = Forest()
    forest.parse(0, "<p>" + "<b>" * 12 + "one<div>two</div>")
    texts = {t: forest.depth[i] for i, t in enumerate(forest.text) if t}
    assert texts["one"] == 14 and texts["two"] == 2
