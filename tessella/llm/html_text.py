"""Main text of web pages by a tree-structured graphical model.

Every element and every text run of a page is a node of a tree.  A node
has a hidden state: page furniture, main content, or a container of
both.  Unary potentials come from what the node shows (tag, words of its
class, id and role, share of link text, amount of text, punctuation,
place among its siblings); parent-child potentials connect neighbours.
Sum-product messages go up the tree and down again, exactly, and yield
each node's marginals; text runs whose content marginal exceeds one half
are kept.  Whole batches of pages are passed through level by level, as
arrays.

The potentials are counted (with smoothing) on labelled pages.
`training_pages` makes them by rules: articles in many layouts, with
menus, headers, footers, sidebars, notices, adverts, forms, related links
and reader comments around and inside them.  `fit` takes any labelled
pages instead.

Blocks: block-level tags and their ends divide a page's text; white space
inside a block (also a line break element) becomes one space; blocks are
trimmed, empty ones vanish, and the others are joined by one newline in
page order.  Character references are decoded.  Scripts, styles,
templates, comments and markup never count as text.

Edge cases: null or empty html gives empty text; html without any tag is
plain text in one paragraph; unclosed and stray tags are repaired the
usual way; repeated rows and null ids keep their rows; an empty table
gives an empty result; other columns are ignored except `carry`.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence, Set
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import tidy

FURNITURE, CONTENT, CONTAINER = range(3)
STATES = 3
SMOOTHING = 0.5
#: Nodes whose messages are computed together.
NODES_AT_ONCE = 40_000

#: Elements whose inside is never text, elements without an end, and elements that end a block.
RAW = "script style template textarea title".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body head address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
TAGS = "#text p div span a b i em strong article main section nav header footer aside form ul ol li h1 h2 h3 h4 h5 h6 table tr td th blockquote pre code figure figcaption button label body html head dl dt dd".split()
#: Words in class, id, role and aria-label that tell furniture and content.
CUES = {
    "furniture": "nav navbar menu breadcrumb breadcrumbs footer header masthead sidebar side widget ad ads advert advertisement banner sponsor sponsored promo cookie consent notice alert popup modal newsletter subscribe signup login search form share social related recommended more tags pagination pager toolbar legal copyright skip".split(),
    "comments": "comment comments reply replies respond discussion disqus reader reviews".split(),
    "content": "article content post entry story main body text page blog prose".split(),
}
CUE_OF = {word: i + 1 for i, words in enumerate(CUES.values()) for word in words}

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|</?[a-zA-Z][^>]*$|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label|data-role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
LABEL = re.compile(r"\bdata-label\s*=\s*\"?(\d)")
SPACE = re.compile(r"\s+")
#: A start tag that ends an open element of these names first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARAGRAPH = frozenset({"p"})
FENCES = frozenset("ul ol dl table body html article section div main aside nav td th blockquote form header footer".split())


@dataclass
class Forest:
    """Nodes of a batch of pages; parent -1 for the roots, parents before children."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    cue: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    page: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    block: list[int] = field(default_factory=list)
    blocks: int = 0

    def add(self, parent: int, tag: str, page: int, cue: int = 0, label: int = -1, text: str | None = None) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.cue.append(cue)
        self.label.append(label)
        self.page.append(page)
        self.text.append(text)
        self.block.append(self.blocks)
        return len(self.parent) - 1

    def parse(self, page: int, source: str, labelled: bool = False) -> None:
        self.blocks += 1
        stack = [(self.add(-1, "html", page), "html")]
        opened: Counter[str] = Counter()  # open elements by name, so that a stray end tag need not look for its start
        at = 0

        def cut(k: int) -> None:
            for _, name in stack[k:]:
                opened[name] -= 1
            del stack[k:]

        def text(piece: str) -> None:
            decoded = html.unescape(piece) if "&" in piece else piece
            if decoded.strip() or (decoded and self.text[-1] is not None and self.block[-1] == self.blocks):
                self.add(stack[-1][0], "#text", page, label=self.label[stack[-1][0]], text=decoded)

        for m in TOKEN.finditer(source):
            if m.start() > at:
                text(source[at : m.start()])
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if not tag:
                continue
            tag = tag.lower()
            block = tag in BLOCKS
            if tag == "br":
                text(" ")
                continue
            if block:
                self.blocks += 1
            if m["end"] or m["end2"]:
                if opened[tag]:
                    k = len(stack) - 1
                    while stack[k][1] != tag:
                        k -= 1
                    cut(k)
                continue
            if tag in ("html", "body"):  # one of each; a second one adds nothing
                if tag == "html" or opened["body"]:
                    continue
            if tag in CLOSES:
                self._close(stack, CLOSES[tag], opened, cut)
            elif block:
                self._close(stack, PARAGRAPH, opened, cut)
            if tag in VOID:
                continue
            attrs = m["attrs"] or ""
            cue, label = 0, -1
            if attrs:
                for a in ATTRIBUTE.finditer(attrs):
                    for word in re.split(r"[^a-z]+", (a[1] or a[2] or a[3] or "").lower()):
                        cue = cue or CUE_OF.get(word, 0)
                if labelled and (found := LABEL.search(attrs)):
                    label = int(found[1])
            node = self.add(stack[-1][0], tag, page, cue, self.label[stack[-1][0]] if label < 0 else label)
            if not attrs.endswith("/"):
                stack.append((node, tag))
                opened[tag] += 1
        if at < len(source):
            text(source[at:])

    @staticmethod
    def _close(stack: list[tuple[int, str]], names: Set[str], opened: Counter[str], cut: Callable[[int], None]) -> None:
        """Ends the nearest open element of these names, if no fence stands before it."""
        if not any(opened[name] for name in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][1] in names:
                cut(k)
                return
            if stack[k][1] in FENCES:
                return


@cache
def _tag_index() -> dict[str, int]:
    return {t: i + 1 for i, t in enumerate(TAGS)}


#: Sizes of the observed features: tag, cue, nearest cue above, link share, text amount, full stops, sibling place.
FEATURES = (len(TAGS) + 1, 4, 4, 4, 5, 3, 3)


def observe(forest: Forest) -> np.ndarray:
    """One row of feature values for each node."""
    n = len(forest.parent)
    parent = np.array(forest.parent)
    index = _tag_index()
    tag = np.array([index.get(t, 0) for t in forest.tag], int)
    cue = np.array(forest.cue)
    size = np.array([len(t) if t else 0 for t in forest.text])
    stops = np.array([t.count(". ") + t.count(", ") + t.endswith((".", "!", "?")) if t else 0 for t in forest.text])
    in_link, above = np.zeros(n, bool), np.zeros(n, int)
    link_tag = index["a"]
    for i, p in enumerate(forest.parent):  # parents come first
        if p >= 0:
            in_link[i] = in_link[p] or tag[p] == link_tag
            above[i] = cue[p] or above[p]
    total, linked, children = size.copy(), np.where(in_link, size, 0), np.zeros(n, int)
    for level in _levels(forest)[:0:-1]:
        for values in (total, linked):
            np.add.at(values, parent[level], values[level])
        np.add.at(children, parent[level], 1)
    share = np.where(total > 0, linked / np.maximum(total, 1), 0.0)
    # An amount of text is evidence once, at its run; elements show only their kind, place and links.
    features = [
        tag,
        cue,
        above,
        np.digitize(share, (0.01, 0.3, 0.7)),
        np.digitize(size, (1, 25, 80, 300)),
        np.digitize(stops, (1, 4)),
        np.digitize(children, (1, 4)),
    ]
    return np.stack(features, axis=1)


def _levels(forest: Forest) -> list[np.ndarray]:
    depth = np.array(forest.depth)
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1])


@dataclass
class TreeModel:
    """Log potentials: unary by feature value and state, edges by parent and child state, roots by state."""

    unary: list[np.ndarray]
    edge: np.ndarray
    root: np.ndarray

    @staticmethod
    def fit(pages: Sequence[str]) -> TreeModel:
        """Counts potentials on pages whose elements carry data-label="0|1|2" (inherited by what is inside)."""
        forest = Forest()
        for i, page in enumerate(pages):
            forest.parse(i, page, labelled=True)
        label = np.array(forest.label)
        label[label < 0] = CONTAINER
        # A text run in a container belongs to neither part by itself; those of a page's frame are furniture.
        text = np.array([t is not None for t in forest.text])
        label[text & (label == CONTAINER)] = FURNITURE
        seen = observe(forest)
        unary = []
        for f, size in enumerate(FEATURES):
            counts = np.full((size, STATES), SMOOTHING)
            np.add.at(counts, (seen[:, f], label), 1)
            unary.append(np.log(counts / counts.sum(axis=0)))
        parent = np.array(forest.parent)
        edge, root = np.full((STATES, STATES), SMOOTHING), np.full(STATES, SMOOTHING)
        child = parent >= 0
        np.add.at(edge, (label[parent[child]], label[child]), 1)
        np.add.at(root, label[~child], 1)
        return TreeModel(unary, np.log(edge / edge.sum(axis=1, keepdims=True)), np.log(root / root.sum()))

    def marginals(self, forest: Forest) -> np.ndarray:
        """P(state) of every node, by one upward and one downward pass."""
        seen, parent, levels = observe(forest), np.array(forest.parent), _levels(forest)
        local = sum(u[seen[:, f]] for f, u in enumerate(self.unary))
        edge = np.exp(self.edge)
        up = local.copy()  # what a node's subtree says about its state
        sent = np.zeros_like(local)  # what its parent hears of it
        for level in levels[:0:-1]:
            high = up[level].max(axis=1, keepdims=True)
            sent[level] = np.log(np.exp(up[level] - high) @ edge.T) + high
            np.add.at(up, parent[level], sent[level])
        down = np.zeros_like(local)
        down[levels[0]] = self.root
        for level in levels[1:]:
            rest = down[parent[level]] + up[parent[level]] - sent[level]
            high = rest.max(axis=1, keepdims=True)
            down[level] = np.log(np.exp(rest - high) @ edge) + high
        belief = up + down
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)

    def extract(self, pages: Sequence[str | None]) -> list[str]:
        out, at = [""] * len(pages), 0
        while at < len(pages):
            forest = Forest()
            while at < len(pages) and len(forest.parent) < NODES_AT_ONCE:
                if pages[at]:
                    forest.parse(at, pages[at])
                at += 1
            if not forest.parent:
                continue
            content = self.marginals(forest)[:, CONTENT] > 0.5
            blocks: dict[tuple[int, int], list[str]] = {}
            for i in np.nonzero(content)[0]:
                if forest.text[i] is not None:
                    blocks.setdefault((forest.page[i], forest.block[i]), []).append(forest.text[i])
            texts: dict[int, list[str]] = {}
            for (page, _), runs in blocks.items():
                if block := SPACE.sub(" ", "".join(runs)).strip():
                    texts.setdefault(page, []).append(block)
            for page, found in texts.items():
                out[page] = "\n".join(found)
        return out


def training_pages(count: int = 1500, seed: int = 11) -> list[str]:
    """Labelled pages by rules: varied layouts around and inside articles of invented words."""
    r = random.Random(seed)
    syllables = "ba de ki lo mu na po ri sa te vo za men tor lis".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: phrase(4, 14).capitalize() + r.choice(".....!?")

    def inline(text: str) -> str:
        words = text.split(" ")
        for _ in range(r.choice((0, 0, 1, 2))):
            i = r.randrange(len(words))
            words[i] = r.choice(("<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<strong>{}</strong>", "<span>{}</span>", "{}<br>")).format(words[i])
        return " ".join(words)

    def paragraph() -> str:
        return inline(" ".join(sentence() for _ in range(r.choice((1, 1, 2, 3, 5)))))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{phrase(1, 3)}</a></li>' for _ in range(n))

    def furniture() -> str:
        k = r.randrange(12)
        cls = lambda *names: f' class="{r.choice(names)}"' if r.random() < 0.8 else ""
        if k == 0:
            return f'<nav{cls("menu", "navbar", "main-nav")} data-label="0"><ul>{links(r.randint(2, 8))}</ul></nav>'
        if k == 1:
            return f'<aside{cls("sidebar", "side", "widget")} data-label="0"><h3>{phrase(1, 3)}</h3><ul>{links(r.randint(2, 6))}</ul><p>{sentence()}</p></aside>'
        if k == 2:
            return f'<div class="{r.choice(("ad", "ads", "advert", "ad-banner", "sponsored", "promo"))}" data-label="0">{r.choice((sentence(), "<p>" + paragraph() + "</p>"))}</div>'
        if k == 3:
            return f'<div class="{r.choice(("cookie-notice", "consent", "notice", "alert"))}" data-label="0"><p>{sentence()}</p><button>{word()}</button></div>'
        if k == 4:
            return f'<form{cls("search", "newsletter", "signup")} data-label="0"><label>{phrase(1, 3)}</label><input name="q"><button>{word()}</button></form>'
        if k == 5:
            return f'<div class="{r.choice(("share", "social", "related", "recommended", "tags", "breadcrumbs", "pagination"))}" data-label="0"><ul>{links(r.randint(1, 5))}</ul></div>'
        if k in (6, 7):
            one = lambda: f'<{r.choice(("li", "div", "article"))} class="comment"><b>{word()}</b><p>{paragraph()}</p></div>'
            return f'<{(t := r.choice(("section", "div")))} {r.choice(("class", "id"))}="{r.choice(("comments", "comment-list", "replies", "discussion"))}" data-label="0"><h3>{phrase(1, 2)}</h3>{"".join(one() for _ in range(r.randint(1, 5)))}</{t}>'
        if k == 8:
            return f'<header{cls("header", "masthead")} data-label="0"><a href="/">{phrase(1, 3)}</a><p>{phrase(2, 6)}</p></header>'
        if k == 9:
            end = r.choice(("", "", f'<a href="/i">{word()}</a>'))
            return f'<footer{cls("footer", "legal")} data-label="0">&copy; {word()}.example &middot; {" ".join(sentence() for _ in range(r.randint(1, 4)))} {end}</footer>'
        if k == 10:
            t = r.choice(("footer", "footer", "aside", "header", "nav"))
            text = " ".join(sentence() for _ in range(r.randint(1, 6)))
            return f'<{t} data-label="0">{r.choice((text, f"<p>{text}</p>", f"<p>{text}<p>{sentence()}"))}</{t}>'
        return f'<div id="{r.choice(("footer", "header", "sidebar", "menu", "login"))}" data-label="0"><p>{sentence()}</p><ul>{links(2)}</ul></div>'

    def block() -> str:
        k = r.randrange(14)
        if k == 0:
            return f"<h{(h := r.randint(2, 4))}>{phrase(1, 6)}</h{h}>"
        if k == 1:
            return f"<ul>{''.join(f'<li>{inline(sentence())}</li>' for _ in range(r.randint(2, 5)))}</ul>"
        if k == 2:
            return f"<blockquote>{r.choice((paragraph(), '<p>' + paragraph() + '</p>'))}</blockquote>"
        if k == 3:
            return f"<table>{''.join(f'<tr><td>{phrase(1, 2)}</td><td>{phrase(1, 3)}</td></tr>' for _ in range(2))}</table>"
        if k == 4:
            return f"<figure><img src='x'><figcaption>{sentence()}</figcaption></figure>"
        if k == 5:
            return f"<pre><code>{phrase(3, 12)}</code></pre>"
        if k == 6:
            return f"<p><b>{paragraph()}<br><p>{paragraph()}</p>"
        if k == 7:
            return f"<div>{paragraph()}</div>"
        return f"<p>{paragraph()}</p>" if r.random() < 0.9 else f"<p>{paragraph()}"

    def body() -> str:
        tag, attrs = r.choice((("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="article-body"'), ("section", ' class="entry"'), ("div", ' class="story"')))
        title = f"<h1>{phrase(1, 9)}</h1>" if r.random() < 0.8 else ""
        inner = [block() for _ in range(r.choice((0, 1, 1, 2, 4, 8)))] or [f"<p>{phrase(1, 6)}</p>"]
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            inner.insert(r.randint(0, len(inner)), furniture())
        made = f"<{tag}{attrs} data-label=\"1\">{title}{''.join(inner)}</{tag}>"
        return made if r.random() < 0.7 else f'<{(w := r.choice(("main", "div")))}{r.choice(("", " class=wrapper"))} data-label="2">{made}{furniture() if r.random() < 0.5 else ""}</{w}>'

    def page() -> str:
        before = "".join(furniture() for _ in range(r.choice((0, 1, 2, 3))))
        after = "".join(furniture() for _ in range(r.choice((0, 1, 2, 3))))
        return f'<html data-label="2"><head data-label="0"><meta charset="utf-8"></head><body data-label="2">{before}{body()}{after}</body></html>'

    return [page() for _ in range(count)]


@cache
def default_model() -> TreeModel:
    return TreeModel.fit(training_pages())


def extract_text(pages: DataFrame, model: TreeModel | None = None, html_col: str = "html", carry: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Returns the `carry` columns, text and n_chars long (its code points), for every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())
    kept = [f"__carry{i}" for i in range(len(carry))]
    rows = pages.select(F.col(f"`{html_col}`").alias("__html"), *[F.col(f"`{c}`").alias(k) for c, k in zip(carry, kept, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = shared.value.extract(part.column("__html").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    schema = T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in kept), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    out = rows.mapInArrow(tidy(run), schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip(carry, kept, strict=True)], "text", "n_chars")


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
