"""Main text of web pages: boosted trees over DOM nodes, decoded over the tree.

Each element with text is described by its tag, the words in its ``class``,
``id`` and ``role``, the same of its ancestors, the density of text and links in
its subtree, its depth, and its place among its siblings.  Gradient-boosted trees
say how likely it is part of the article.  Decoding finds the best consistent
choice for the whole page: a subtree is taken whole, dropped whole, or its
children are decided one by one; so no element is kept within one that was
dropped, nor dropped within one that was kept whole.

The trees are trained here, on ``TRAINING_PAGES`` pages that ``training_page``
makes up: many layouts, with and without telling tags and names.

Defined results: a null or empty page has an empty text; pages of any size and
nesting are read whole; scripts, styles and comments of the markup never count;
character references are decoded; no-break spaces are white space; repeated
rows each get a row; extra columns are dropped; an empty table gives an empty
table.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship_code
from .boosting import BoostedTrees
from .dom import Page, joined_text

TRAINING_PAGES = 700
SEED = 5
#: Nodes that are worked on at once, at about this number.
FLAT_NODES = 60_000
#: Cost of deciding children one by one.
SPLIT_COST = 0.5

TAG_GROUPS = [
    {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "menu", "dl"}, {"li", "dt", "dd"}, {"a"}, {"div"}, {"section"},
    {"article", "main"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "label", "button", "input", "legend", "option"},
    {"table", "tbody", "thead", "tr", "td", "th", "caption"}, {"b", "strong", "i", "em", "span", "u", "small", "code", "sup", "sub", "mark", "font"},
    {"blockquote", "pre", "figure", "figcaption"}, {"body", "html", "#document"}, {"dialog", "details", "summary", "address"},
]
#: Words in class, id and role by what they stand for.
NAME_GROUPS = [
    set("article content main post entry story body text blog page hentry prose".split()),
    set("nav navigation menu navbar breadcrumb breadcrumbs pagination pager tabs toc skip".split()),
    set("header head masthead top topbar banner logo branding hero".split()),
    set("footer foot bottom copyright legal colophon imprint".split()),
    set("sidebar side aside widget rail secondary complementary".split()),
    set("ad ads advert advertisement adverts sponsor sponsored promo promotion promoted dfp banner".split()),
    set("cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe signup warning message toast".split()),
    set("comment comments reply replies discussion respond disqus reader responses feedback".split()),
    set("form search login register contact poll survey input".split()),
    set("related recommended share sharing social tags tag more links popular trending author meta byline".split()),
]
GROUP_OF_TAG = {tag: k for k, group in enumerate(TAG_GROUPS) for tag in group}
GROUPS_OF_NAME: dict[str, int] = {}
for _k, _group in enumerate(NAME_GROUPS):
    for _name in _group:
        GROUPS_OF_NAME[_name] = GROUPS_OF_NAME.get(_name, 0) | 1 << _k
TAGS, NAMES = len(TAG_GROUPS), len(NAME_GROUPS)


class Nodes:
    """The nodes of several pages in one numbering, with their features."""

    def __init__(self, pages: list[Page]):
        self.sizes = np.array([len(p.tags) for p in pages])
        self.begins = np.cumsum(self.sizes) - self.sizes
        n = int(self.sizes.sum())
        shift = np.repeat(self.begins, self.sizes)
        parent = np.fromiter((q for p in pages for q in p.parents), np.int64, n)
        self.parent = np.where(parent < 0, -1, parent + shift)
        self.depth = np.fromiter((d for p in pages for d in p.depths), np.int64, n)
        self.tag = np.fromiter((GROUP_OF_TAG.get(t, TAGS - 1) for p in pages for t in p.tags), np.int64, n)
        self.page = np.repeat(np.arange(len(pages)), self.sizes)
        names = np.zeros(n, np.int64)
        text, words, stops = np.zeros(n), np.zeros(n), np.zeros(n)
        for page, begin in zip(pages, self.begins.tolist(), strict=True):
            for k, own in enumerate(page.names):
                for name in own:
                    names[begin + k] |= GROUPS_OF_NAME.get(name, 0)
            for node, _, piece in page.pieces:
                if piece.isspace():
                    continue
                at = begin + node
                text[at] += len(piece)
                words[at] += piece.count(" ") + 1
                stops[at] += piece.count(",") + piece.count(".")
        self.own_text = text.copy()
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(self.depth.max() + 2)) if n else np.zeros(1, np.int64)
        self.levels = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        link = np.where(self.tag == GROUP_OF_TAG["a"], text, 0)
        paragraphs = (self.tag == GROUP_OF_TAG["p"]).astype(float)
        sums = np.stack([text, words, stops, link, paragraphs, np.ones(n)], 1)
        for level in reversed(self.levels[1:]):
            inner = level[self.tag[level] == GROUP_OF_TAG["a"]]
            sums[inner, 3] = sums[inner, 0]
            np.add.at(sums, self.parent[level], sums[level])
        above = np.zeros(n, np.int64)
        mark = names | (1 << self.tag + NAMES)
        for level in self.levels[1:]:
            above[level] = above[self.parent[level]] | mark[self.parent[level]]
        self.text = sums[:, 0]
        self.x = self._features(names, above, sums)

    def _features(self, names: np.ndarray, above: np.ndarray, sums: np.ndarray) -> np.ndarray:
        n, up = len(names), np.maximum(self.parent, 0)
        text, words, stops, link, paragraphs, count = sums.T
        page_text = np.maximum(text[self.begins][self.page] if n else text, 1)
        children = np.bincount(self.parent[self.parent >= 0], minlength=n)
        # place among siblings: nodes are in document order
        order = np.lexsort((np.arange(n), self.parent))
        first = np.r_[True, self.parent[order][1:] != self.parent[order][:-1]] if n else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        index = np.zeros(n, np.int64)
        index[order] = np.arange(n) - start
        same_key = up * TAGS + self.tag
        _, inverse, same = np.unique(same_key, return_inverse=True, return_counts=True)
        siblings = np.maximum(children[up], 1)
        running = np.cumsum(self.own_text) - self.own_text
        offset = running - running[self.begins][self.page] if n else running
        bits = lambda value, width: ((value[:, None] >> np.arange(width)) & 1)
        numbers = np.stack(
            [
                self.depth, np.log1p(text), np.log1p(words), link / np.maximum(text, 1), stops / np.maximum(words, 1), np.log1p(paragraphs),
                text / np.maximum(count, 1), words / np.maximum(paragraphs, 1), children, index / siblings, siblings, same[inverse] / siblings,
                text / np.maximum(text[up], 1), text / page_text, offset / page_text, self.own_text / np.maximum(text, 1),
                np.log1p(text[up]), link[up] / np.maximum(text[up], 1),
            ],
            1,
        )
        own_tag = (self.tag[:, None] == np.arange(TAGS)).astype("f4")
        parent_tag = (self.tag[up][:, None] == np.arange(TAGS)).astype("f4")
        return np.concatenate([numbers, own_tag, parent_tag, bits(names, NAMES), bits(above, NAMES + TAGS)], 1).astype("f4")

    def decode(self, margin: np.ndarray) -> np.ndarray:
        """Whether each node's own text is taken, by the best consistent choice for each page."""
        n = len(margin)
        margin = np.where(self.text > 0, np.clip(margin, -6, 6), 0)
        take, drop = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
        split = np.where(self.own_text > 0, np.maximum(take, drop), 0) - SPLIT_COST
        best = np.zeros(n)
        for level in reversed(self.levels):
            best[level] = np.maximum(np.maximum(take[level], drop[level]), split[level])
            up = self.parent[level]
            if len(level) and up[0] >= 0:
                for total, part in ((take, take), (drop, drop), (split, best)):
                    np.add.at(total, up, part[level])
        choice = np.where(split >= np.maximum(take, drop), 2, np.where(take >= drop, 1, 0))
        for level in self.levels[1:]:
            held = choice[self.parent[level]]
            choice[level] = np.where(held == 2, choice[level], held)
        return np.where(choice == 2, margin > 0, choice == 1)


# Pages to learn from

MARK = ""


class Writer:
    """Makes up a page; text of the article carries a mark."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.syllables = [rng.choice("bcdfghlmnprstvw") + rng.choice("aeiou") for _ in range(40)]

    def words(self, least: int, most: int) -> str:
        rng, out = self.rng, []
        for _ in range(rng.randint(least, most)):
            out.append("".join(rng.choices(self.syllables, k=rng.randint(1, 4))) + rng.choice(["", "", "", "", ",", ".", "&amp;", "!!"]))
        return " ".join(out).capitalize()

    def name(self, *stems: str) -> str:
        rng = self.rng
        if rng.random() < 0.25:
            return rng.choice(["", ' class="box"', f' id="x{rng.randint(1, 99)}"', ' class="wrap inner"', ' class="col row"'])
        stem = rng.choice(stems)
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(["", "site-", "page-", "c-", "the_"])}{stem}{rng.choice(["", "-1", " wide", "-box", "Area"])}"'

    def paragraph(self) -> str:
        rng = self.rng
        size = rng.choice([(1, 2), (2, 8), (5, 30), (20, 80), (60, 200)])
        text = MARK + self.words(*size)
        if rng.random() < 0.15:
            text += f" <a href='/x'>{MARK}{self.words(1, 4)}</a> {MARK}{self.words(1, 9)}"
        if rng.random() < 0.15:
            text = f"<b>{text}" + rng.choice(["</b>", "<br>", "</b><br>"])
        return text

    def article(self) -> str:
        rng, out = self.rng, []
        if rng.random() < 0.85:
            head = f"<h1>{MARK}{self.words(1, 12)}</h1>"
            out.append(f"<header>{head}</header>" if rng.random() < 0.12 else head)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 15, 30])):
            kind = rng.random()
            if kind < 0.72:
                out.append(f"<p>{self.paragraph()}" + rng.choice(["</p>", "</p>", ""]))
            elif kind < 0.8:
                level = rng.randint(2, 4)
                out.append(f"<h{level}>{MARK}{self.words(1, 8)}</h{level}>")
            elif kind < 0.87:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.words(1, 14)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.91:
                out.append(f"<blockquote><p>{MARK}{self.words(4, 40)}</p></blockquote>")
            elif kind < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{self.words(1, 4)}</td><td>{MARK}{self.words(1, 4)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif kind < 0.97:
                out.append(f"<div>{MARK}{self.words(5, 60)}</div>")
            else:
                out.append(self.advert())
        if not out:
            out.append(f"<p>{MARK}{self.words(1, 30)}</p>")
        return "\n".join(out)

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{self.words(1, 3)}</a></li>' for k in range(n)) + "</ul>"

    def advert(self) -> str:
        tag = self.rng.choice(["div", "div", "aside", "section"])
        inner = self.words(1, 40) if self.rng.random() < 0.6 else f"<p>{self.words(2, 40)}</p>"
        return f'<{tag} class="{self.rng.choice(["ad", "ads", "advert", "ad-banner", "sponsored", "promo box", "advertisement"])}">{inner}</{tag}>'

    def notice(self) -> str:
        tag = self.rng.choice(["div", "div", "aside", "section", "dialog"])
        name = self.rng.choice(["cookie-notice", "notice", "cookies", "consent", "alert", "gdpr-banner", "newsletter", "popup", "subscribe"])
        inner = self.rng.choice([self.words(3, 40), f"<p>{self.words(3, 40)}</p><button>{self.words(1, 2)}</button>"])
        return f'<{tag} {self.rng.choice(["class", "id"])}="{name}">{inner}</{tag}>'

    def comments(self) -> str:
        rng = self.rng
        one = lambda: rng.choice(['<li class="comment">{}</li>', '<div class="comment">{}</div>', '<article class="comment">{}</article>']).format(f"<p>{self.words(2, 60)}</p>" if rng.random() < 0.7 else self.words(2, 60))
        body = "".join(one() for _ in range(rng.randint(1, 6)))
        head = f"<h3>{self.words(1, 3)}</h3>" if rng.random() < 0.6 else ""
        return f'<{rng.choice(["div", "section", "ol"])} {rng.choice(["class", "id"])}="{rng.choice(["comments", "reader-comments", "comment-list", "discussion", "replies"])}">{head}{body}</div></section></ol>'

    def form(self) -> str:
        return f'<form{self.name("search", "login", "contact")}><label>{self.words(1, 4)}</label><input name="q"><button>{self.words(1, 2)}</button>{f"<p>{self.words(2, 20)}</p>" if self.rng.random() < 0.4 else ""}</form>'

    def sidebar(self) -> str:
        tag = self.rng.choice(["aside", "aside", "div"])
        name = self.name("sidebar", "widget", "side") if tag == "aside" else f' class="{self.rng.choice(["sidebar", "widget", "side-rail", "related"])}"'
        inner = self.rng.choice([self.links(self.rng.randint(2, 8)), f"<p>{self.words(3, 50)}</p>", f"<h3>{self.words(1, 4)}</h3><p>{self.words(3, 30)}</p>", self.words(3, 40)])
        return f"<{tag}{name}>{inner}</{tag}>"


def training_page(rng: random.Random) -> str:
    """A made-up page; text of its article carries ``MARK``."""
    w = Writer(rng)
    some = lambda chance, make: make() if rng.random() < chance else ""
    article = w.article()
    inside = [some(0.12, w.comments), some(0.1, w.advert), some(0.06, w.form), some(0.08, w.sidebar)]
    rng.shuffle(inside)
    kind = rng.random()
    if kind < 0.5:
        body = f"<article{some(0.3, lambda: w.name('post', 'article', 'entry'))}>{article}{''.join(inside)}</article>"
    elif kind < 0.7:
        body = f"<main>{article}{''.join(inside)}</main>"
    elif kind < 0.9:
        body = f'<div class="{rng.choice(["content", "post", "entry-content", "article-body", "main-text", "story"])}">{article}{"".join(inside)}</div>'
    else:
        body = f"<div>{article}</div>"
    if rng.random() < 0.25:
        body = f"<div{w.name('wrapper', 'container', 'page')}>{body}</div>"
    nav = lambda: f"<nav{some(0.3, lambda: w.name('menu', 'navbar'))}>{w.links(rng.randint(2, 10))}</nav>" if rng.random() < 0.75 else f'<div class="{rng.choice(["menu", "nav", "navigation", "breadcrumbs"])}">{w.links(rng.randint(2, 8))}</div>'
    header = lambda: f"<header>{some(0.7, lambda: f'<h1>{w.words(1, 4)}</h1>')}{some(0.4, lambda: f'<p>{w.words(1, 12)}</p>')}{some(0.5, nav)}</header>" if rng.random() < 0.8 else f'<div class="{rng.choice(["header", "masthead", "top-banner"])}">{w.words(1, 12)}</div>'
    footer = lambda: f"<footer>{rng.choice([w.words(2, 60), f'<p>&copy; {w.words(2, 40)}</p>', w.links(4)])}</footer>" if rng.random() < 0.8 else f'<div class="footer">{w.words(2, 50)}</div>'
    before = [some(0.75, nav), some(0.5, header), some(0.45, w.advert), some(0.25, w.notice), some(0.15, w.form), some(0.15, w.sidebar)]
    after = [some(0.3, w.comments), some(0.35, w.sidebar), some(0.25, w.advert), some(0.15, w.form), some(0.12, w.notice), some(0.1, nav)]
    rng.shuffle(before)
    rng.shuffle(after)
    title = f"<head><title>{w.words(1, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
    return f"<!DOCTYPE html><html>{some(0.9, lambda: title)}<body>{''.join(before)}<!-- x -->{body}{''.join(after)}{some(0.85, footer)}" + rng.choice(["</body></html>", ""])


def train(pages: int = TRAINING_PAGES, seed: int = SEED) -> BoostedTrees:
    """Fit the trees on nodes whose text is all of the article or none of it."""
    rng = random.Random(seed)
    parsed, marked = [], []
    for _ in range(pages):
        page = Page(training_page(rng))
        inside = np.zeros(len(page.tags))
        for k, (node, block, text) in enumerate(page.pieces):
            plain = text.replace(MARK, "")
            if not plain.isspace() and MARK in text:
                inside[node] += len(plain)
            page.pieces[k] = (node, block, plain)
        parsed.append(page)
        marked.append(inside)
    nodes = Nodes(parsed)
    inside = np.concatenate(marked)
    for level in reversed(nodes.levels[1:]):
        np.add.at(inside, nodes.parent[level], inside[level])
    share = inside / np.maximum(nodes.text, 1)
    pure = (nodes.text > 0) & ((share < 0.02) | (share > 0.98))
    return BoostedTrees().fit(nodes.x[pure], (share[pure] > 0.5).astype(float))


def extract(pages: list[str], model: BoostedTrees) -> list[str]:
    """Main texts of pages."""
    out: list[str] = []
    held: list[Page] = []

    def flush() -> None:
        nodes = Nodes(held)
        taken = nodes.decode(model.margins(nodes.x))
        for page, begin, size in zip(held, nodes.begins.tolist(), nodes.sizes.tolist(), strict=True):
            out.append(joined_text(page.pieces, taken[begin : begin + size].tolist()))
        held.clear()

    count = 0
    for html in pages:
        held.append(Page(html))
        count += len(held[-1].tags)
        if count >= FLAT_NODES:
            flush()
            count = 0
    if held:
        flush()
    return out


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for each row."""
    spark = pages.sparkSession
    ship_code(spark)
    model = spark.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                texts = extract([h or "" for h in batch.column(2).to_pylist()], model.value)
                columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
