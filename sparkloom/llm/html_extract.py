"""Main text of HTML pages: boosted trees over DOM nodes, decoded along the tree.

Nodes are block elements and the runs of text between block boundaries.  Each has
features of its subtree (text, links, tags, density), its id, class and role
tokens, its tag, depth, place and siblings.  Gradient-boosted trees give every node
the log odds of holding main text.  Decoding picks the labels of greatest total
log odds under one rule: what lies in a dropped node is dropped.  The trees are
trained on pages made up here, from a fixed seed; nothing is stored.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import groups, pick

#: Attributes are matched possessively, so no input makes the pattern backtrack.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^<>"']++|"[^"]*"|'[^']*'|["'])*+)>""", re.S)
_ATTR = re.compile(r"""(?<![\w-])(id|class|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: Elements whose content is no text of the page.
SILENT = frozenset("script style title noscript template iframe svg canvas object math audio video textarea select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr blockquote pre figure figcaption nav header footer aside form fieldset legend label button address details summary dialog menu search center hgroup".split()
)
#: An opening tag ends an open element of these, up to the nearest of the stops.
_ENDS = {
    **{t: ({"p"}, {"button", "table", "li", "div", "section", "article", "body"}) for t in BLOCK - {"html", "body", "label", "button", "legend", "caption", "thead", "tbody", "tfoot", "tr", "summary"}},
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
}

#: Kinds of tokens in id, class and role that features count.
TOKENS = {
    "content": "content contents article post posts entry story main text body page hentry blog news primary detail details".split(),
    "menu": "nav navbar navigation menu menus topnav breadcrumb breadcrumbs tabs toolbar pagination pager pages toc skip".split(),
    "head": "header head masthead topbar logo brand hero".split(),
    "foot": "footer foot copyright bottom colophon legal".split(),
    "side": "sidebar side aside widget widgets rail complementary secondary related recommended popular trending more teaser".split(),
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner billboard dfp outbrain taboola affiliate".split(),
    "notice": "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup paywall disclaimer message".split(),
    "comment": "comment comments disqus reply replies respond response responses discussion reader readers review reviews feedback thread".split(),
    "social": "share sharing social follow like tweet facebook twitter tags tag meta byline author".split(),
    "form": "form search login contact input field captcha".split(),
}
_KIND = {w: k for k, ws in enumerate(TOKENS.values()) for w in ws}
_TAGS = ["#text", "p", "div", "section", "article", "main", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "tr", "blockquote", "pre", "figure", "figcaption", "button", "label", "body", "dl", "dialog"]
_TAG = {t: k for k, t in enumerate(_TAGS)}
#: Tags that matter wherever they stand above a node.
_ABOVE = ["article", "main", "nav", "header", "footer", "aside", "form", "ul", "table", "figure", "dialog", "button", "label"]


@dataclass
class Page:
    """The block tree of a page, parents before children, in page order."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)  # of text nodes
    links: list[int] = field(default_factory=list)  # characters of the text inside links
    anchors: list[int] = field(default_factory=list)

    def add(self, tag: str, parent: int, attrs: str = "", text: str = "", links: int = 0, anchors: int = 0) -> int:
        for column, x in zip((self.tag, self.parent, self.attrs, self.text, self.links, self.anchors), (tag, parent, attrs, text, links, anchors)):
            column.append(x)
        return len(self.tag) - 1


def parse(source: str) -> Page:
    """Block tree of HTML in any state: unclosed, misnested and unknown tags are fine."""
    page = Page()
    stack = [("#root", page.add("#root", -1))]
    opened: Counter[str] = Counter()
    run: list[str] = []
    linked = anchors = in_link = 0

    def above() -> int:
        return stack[-1][1] if stack[-1][1] >= 0 else stack[-2][1]

    def flush() -> None:
        nonlocal linked, anchors
        if run:
            text = _SPACE.sub(" ", "".join(run)).strip()
            if text:
                page.add("#text", above(), "", text, min(linked, len(text)), anchors)
            run.clear()
        linked = anchors = 0

    def close(depth: int) -> None:
        nonlocal in_link
        for tag, node in reversed(stack[depth:]):
            if node >= 0:
                flush()
            in_link -= tag == "a"
            opened[tag] -= 1
        del stack[depth:]

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        piece = source[at : m.start() if m else end]
        if piece:
            piece = html.unescape(piece)
            run.append(piece)
            if in_link:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if tag in SILENT:
                if not m[3].endswith("/"):
                    stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                    at = stop.end() if stop else end
                run.append(" ")
            elif tag in VOID or tag in ("td", "th"):
                run.append(" ")
                if tag == "hr":
                    flush()
            else:
                ends, stops = _ENDS.get(tag, ((), ()))
                if any(opened[t] for t in ends):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in ends:
                            close(k)
                            break
                        if stack[k][0] in stops:
                            break
                if tag in BLOCK:
                    flush()
                    stack.append((tag, page.add(tag, above(), m[3])))
                    opened[tag] += 1
                elif tag == "a":  # other inline elements change nothing
                    if stack[-1][0] == "a":
                        close(len(stack) - 1)
                    in_link += 1
                    anchors += 1
                    stack.append((tag, -1))
                    opened[tag] += 1
        elif m[1] and opened[tag := m[1].lower()]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][1] >= 0 and tag not in BLOCK:
                    break  # an inline end tag doesn't close a block
    close(1)
    flush()
    return page


def _kinds(attrs: str) -> np.ndarray:
    out = np.zeros(len(TOKENS), np.float32)
    for m in _ATTR.finditer(attrs):
        for w in _WORDS.findall(m[2] or m[3] or m[4] or ""):
            k = _KIND.get(w.lower())
            if k is not None:
                out[k] += 1
    return np.minimum(out, 2)


def feature_rows(page: Page) -> Callable[[int, int], np.ndarray]:
    """The features of nodes ``a`` to ``b``, a row for each; a huge page never has all its rows at once."""
    n, k = len(page.tag), len(TOKENS)
    parent = np.array(page.parent)
    own = np.array([len(t) for t in page.text], float)
    words = np.array([t.count(" ") + 1 if t else 0 for t in page.text], float)
    stops = np.array([sum(map(t.count, ".,;:!?")) if t else 0 for t in page.text], float)
    link, anchor = np.array(page.links, float), np.array(page.anchors, float)
    sums = np.stack([own, words, stops, link, anchor, np.ones(n), np.array([t == "p" for t in page.tag], float), (own > 0).astype(float), (own > 120).astype(float)])
    before = np.concatenate(([0.0], np.cumsum(own)[:-1]))
    depth, kinds, above = np.zeros(n), np.zeros((n, k), np.float32), np.zeros((n, len(_ABOVE)), np.float32)
    over = np.zeros((n, k), np.float32)
    memo: dict[str, np.ndarray] = {}
    for i in range(n):
        p = parent[i]
        if page.attrs[i]:
            if page.attrs[i] not in memo:
                memo[page.attrs[i]] = _kinds(page.attrs[i])
            kinds[i] = memo[page.attrs[i]]
        if p >= 0:
            depth[i] = depth[p] + 1
            np.maximum(over[p], kinds[p], out=over[i])
            above[i] = above[p]
            if page.tag[p] in _ABOVE:
                above[i, _ABOVE.index(page.tag[p])] = 1
    for i in range(n - 1, 0, -1):
        sums[:, parent[i]] += sums[:, i]
    size, total = sums[0], max(sums[0, 0], 1.0)
    up = np.maximum(parent, 0)
    siblings = np.bincount(up[1:], minlength=n)[up] if n > 1 else np.ones(n)
    order = np.zeros(n)
    seen: dict[int, int] = {}
    for i in range(n):
        order[i] = seen[parent[i]] = seen.get(int(parent[i]), -1) + 1
    tag = np.array([_TAG.get(t, len(_TAGS)) for t in page.tag])

    def rows(a: int, b: int) -> np.ndarray:
        at, u, t = slice(a, b), up[a:b], tag[a:b]
        z, total_z = size[at], np.maximum(size[u], 1.0)
        columns = [
            np.log1p(z), np.log1p(sums[1, at]), sums[2, at] / np.maximum(sums[1, at], 1), sums[3, at] / np.maximum(z, 1), np.log1p(sums[4, at]), z / sums[5, at], np.log1p(sums[5, at]), np.log1p(sums[6, at]),
            np.log1p(sums[8, at]), z / np.maximum(sums[7, at], 1), z / total, before[at] / total, 1 - (before[at] + z) / total, depth[at], np.minimum(siblings[at], 50), order[at] / np.maximum(siblings[at], 1), z / total_z,
            np.log1p((size[u] - z) / np.maximum(siblings[at] - 1, 1)), np.log1p(size[u]), sums[3][u] / total_z, size[u] / np.maximum(sums[7][u], 1), (t == 0).astype(float), np.full(len(t), np.log1p(total)),
        ]
        hot = [(t == j).astype(np.float32) for j in range(1, len(_TAGS))] + [(tag[u] == _TAG[x]).astype(np.float32) for x in ("p", "div", "li", "h1", "h2", "body", "section")]
        return np.column_stack([*columns, *hot, kinds[at], kinds[u], over[at], above[at]]).astype(np.float32)

    return rows


def node_features(page: Page) -> np.ndarray:
    """A row for each node."""
    return feature_rows(page)(0, len(page.tag))


@dataclass
class BoostedTrees:
    """Logistic gradient boosting over histograms; trees are complete, of fixed depth."""

    trees: int = 50
    depth: int = 5
    rate: float = 0.2
    bins: int = 32
    ridge: float = 2.0
    base: float = 0.0
    grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        cell = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        score = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            at = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                m = 2**level
                sum_g, sum_h = np.bincount(at, g, m), np.bincount(at, h, m)
                best, split = np.full(m, 1e-6), [(0, np.inf, self.bins)] * m
                for j in range(f):
                    if not len(edges[j]):
                        continue
                    key = at * self.bins + cell[j]
                    left_g = np.bincount(key, g, m * self.bins).reshape(m, -1).cumsum(1)[:, : len(edges[j])]
                    left_h = np.bincount(key, h, m * self.bins).reshape(m, -1).cumsum(1)[:, : len(edges[j])]
                    gain = left_g**2 / (left_h + self.ridge) + (sum_g[:, None] - left_g) ** 2 / (sum_h[:, None] - left_h + self.ridge) - (sum_g**2 / (sum_h + self.ridge))[:, None]
                    k = gain.argmax(1)
                    for i in np.flatnonzero(gain[np.arange(m), k] > best):
                        best[i], split[i] = gain[i, k[i]], (j, float(edges[j][k[i]]), int(k[i]))
                base = m - 1
                for i, (j, c, _k) in enumerate(split):
                    feature[base + i], cut[base + i] = j, c
                js = np.array([s[0] for s in split])[at]
                at = 2 * at + (cell[js, np.arange(n)] > np.array([s[2] for s in split])[at])
            leaf = -self.rate * np.bincount(at, g, 2**self.depth) / (np.bincount(at, h, 2**self.depth) + self.ridge)
            score += leaf[at]
            self.grown.append((feature, cut, leaf))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.grown:
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = at + 2**level - 1
                at = 2 * at + (x[rows, feature[node]] > cut[node])
            out += leaf[at]
        return out


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the greatest sum of log odds in which no kept node has a dropped ancestor."""
    n = len(page.tag)
    gain = np.clip(odds, -8, 8)
    gain[0] = 0.0
    best = gain.copy()
    for i in range(n - 1, 0, -1):
        best[page.parent[i]] += max(best[i], 0.0)
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and best[i] > 0
    return kept


def main_text(page: Page, odds: np.ndarray) -> str:
    kept = decode(page, odds)
    return "\n".join(t for t, k in zip(page.text, kept) if k and t)


# ---- training pages

_MARK = "\ue000"  # begins a text that is main text
_SYLLABLES = "an en ti ou re le mo ra si ta ber gen lich ung ción ado que ment tion er in on es".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        out = [("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))) for _ in range(r.randint(lo, hi))]
        if out and len(out) > 3 and r.random() < 0.9:
            out = [w + ("," if r.random() < 0.08 else "." if r.random() < 0.08 else "") for w in out]
            out[-1] = out[-1].rstrip(".,") + "."
        return " ".join(out).capitalize()

    def name(self, kind: str) -> str:
        r = self.r
        w = r.choice(TOKENS[kind])
        return {0: w, 1: f"{w}-{r.choice('box wrap area block inner list item top bar container'.split())}", 2: f"{r.choice('site page c my js l'.split())}-{w}", 3: f"{w}{r.randint(1, 9)}", 4: w.capitalize() + "Box"}[r.randint(0, 4)]

    def attr(self, kind: str | None) -> str:
        r = self.r
        if kind is None or r.random() < 0.1:
            return r.choice(["", "", f' class="x{r.randint(1, 99)}"', f' id="b{r.randint(1, 99)}"', ' class="row col"'])
        return r.choice([' class="{}"', ' id="{}"', " class='{} wide'", ' class="col {}"']).format(self.name(kind))

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{k}">{self.words(1, 3)}</a></li>' for k in range(n))

    def close(self, tag: str) -> str:
        return "" if tag in ("p", "li") and self.r.random() < 0.1 else f"</{tag}>"

    def paragraph(self, mark: str, lo: int = 1, hi: int = 120) -> str:
        r = self.r
        text = mark + self.words(lo, hi if r.random() < 0.8 else 8)
        if r.random() < 0.15:
            w = text.split(" ")
            k = r.randrange(len(w))
            w[k] = f'<a href="#">{w[k]}</a>' if k else w[k]
            text = " ".join(w)
        if r.random() < 0.1:
            text = "<b>" + text + r.choice(["</b>", "", "<br>"])
        return f"<p>{text}{self.close('p')}"

    def article(self) -> str:
        r, m = self.r, _MARK
        out = []
        if r.random() < 0.8:
            out.append(r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>"]).format(m + self.words(2, 14)))
        for _ in range(r.choice([1, 2, 3, 5, 8, 14, 30])):
            x = r.random()
            if x < 0.72:
                out.append(self.paragraph(m))
            elif x < 0.8:
                out.append(f"<{(h := r.choice(['h2', 'h3']))}>{m + self.words(1, 8)}</{h}>")
            elif x < 0.86:
                out.append("<ul>" + "".join(f"<li>{m + self.words(2, 20)}{self.close('li')}" for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.9:
                out.append(f"<blockquote>{self.paragraph(m)}</blockquote>")
            elif x < 0.93:
                out.append(f"<pre>{m + self.words(3, 30)}</pre>")
            elif x < 0.96:
                out.append("<table>" + "".join(f"<tr><td>{m + self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif x < 0.98:
                out.append(f"<div>{m + self.words(10, 60)}</div>")
            else:
                out.append(self.advert())
            if r.random() < 0.06:
                out.append(self.intruder())
        if r.random() < 0.2:
            out.append(self.intruder())
        if r.random() < 0.12:
            out.append(f"<div{self.attr('social')}><ul>{self.links(r.randint(2, 5))}</ul></div>")
        return "".join(out)

    def intruder(self) -> str:
        """What may stand inside an article, with or without a class, and is no part of it."""
        r = self.r
        text = r.choice(["<p>{}</p>", "{}", "<div>{}</div>"]).format(self.words(1, 40))
        return r.choice([
            lambda: f"<form{r.choice(['', self.attr('form')])}>{r.choice(['', text, f'<label>{self.words(1, 4)}</label>'])}<input type='text'>{r.choice(['', f'<p>{self.words(2, 20)}</p>'])}{r.choice(['', f'<button>{self.words(1, 2)}</button>'])}</form>",
            lambda: f"<footer{r.choice(['', self.attr('foot')])}>{text}</footer>",
            lambda: f"<aside{r.choice(['', self.attr('side')])}>{r.choice(['', f'<h3>{self.words(1, 4)}</h3>'])}{text}</aside>",
            lambda: f"<{(t := r.choice(['button', 'label']))}>{self.words(1, 5)}</{t}>",
            lambda: f"<{(t := r.choice(['button', 'label']))}>{self.words(1, 5)}</{t}>",
            lambda: f"<p><{(t := r.choice(['button', 'label']))}>{self.words(1, 5)}</{t}></p>",
            lambda: f"<nav><ul>{self.links(r.randint(2, 6))}</ul></nav>",
        ])()

    def advert(self) -> str:
        return self.r.choice(['<div class="ad">{}</div>', f"<div{self.attr('advert')}>{{}}</div>", f"<div{self.attr('advert')}><p>{{}}</p></div>", f"<aside{self.attr('advert')}><a href='#'>{{}}</a></aside>"]).format(self.words(2, 30))

    def comments(self) -> str:
        r = self.r
        one = lambda: f"<{(t := r.choice(['li', 'div', 'article']))}{self.attr('comment')}>{r.choice(['<b>{}</b>', '<h4>{}</h4>', '<span>{}</span>']).format(self.words(1, 2))}{self.paragraph('', 3, 60)}</{t}>"
        return f"<{(t := r.choice(['section', 'div', 'div']))} {r.choice(['id', 'class'])}=\"{self.name('comment')}\"><h3>{self.words(1, 3)}</h3>{r.choice(['{}', '<ul>{}</ul>', '<ol>{}</ol>']).format(''.join(one() for _ in range(r.randint(1, 8))))}</{t}>"

    def form(self) -> str:
        return f"<form{self.r.choice(['', self.attr('form')])}><label>{self.words(1, 3)}</label><input type='text'>{self.r.choice(['', f'<p>{self.words(3, 20)}</p>'])}<button>{self.words(1, 2)}</button></form>"

    def notice(self) -> str:
        return f"<{(t := self.r.choice(['div', 'section', 'dialog', 'aside']))}{self.attr('notice')}>{self.r.choice(['<p>{}</p>', '{}']).format(self.words(4, 50))}<button>{self.words(1, 1)}</button></{t}>"

    def side(self) -> str:
        r = self.r
        inner = "".join(r.choice([lambda: f"<h3>{self.words(1, 3)}</h3><ul>{self.links(r.randint(2, 8))}</ul>", lambda: f"<p>{self.words(5, 40)}</p>", self.form, self.advert])() for _ in range(r.randint(1, 4)))
        return f"<aside{r.choice(['', self.attr('side')])}>{inner}</aside>" if r.random() < 0.5 else f"<div{self.attr('side')}>{inner}</div>"

    def top(self) -> str:
        r = self.r
        menu = f"<ul>{self.links(r.randint(2, 9))}</ul>"
        menu = r.choice([f"<nav>{menu}</nav>", f"<nav{self.attr('menu')}>{menu}</nav>", f"<div{self.attr('menu')}>{menu}</div>"])
        x = r.random()
        if x < 0.4:
            return menu
        if x < 0.5:
            return f"<header>{r.choice(['', menu])}{r.choice(['<p>{}</p>', '{}', '<h1>{}</h1><p>{}</p>', '<div>{}</div>']).replace('{}', self.words(1, 14))}{r.choice(['', menu])}</header>"
        return f"<header{self.attr('head')}><div>{r.choice(['<h1>{}</h1>', '<a href=/>{}</a>', '<p>{}</p>']).format(self.words(1, 8))}</div>{menu}</header>" if x < 0.75 else f"<div{self.attr('head')}>{self.words(1, 10)}</div>{menu}"

    def foot(self) -> str:
        r = self.r
        inner = r.choice([f"&copy; {self.words(1, 3)} &middot; {self.words(2, 20)}", f"<ul>{self.links(r.randint(2, 8))}</ul><p>{self.words(3, 25)}</p>", f"<p>{self.words(3, 40)}</p>"])
        return f"<footer{r.choice(['', self.attr('foot')])}>{inner}</footer>" if r.random() < 0.7 else f"<div{self.attr('foot')}>{inner}</div>"

    def page(self) -> str:
        r = self.r
        body = self.article()
        inner = self.comments() if r.random() < 0.2 else ""
        core = r.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", f"<div{self.attr('content')}>{{}}</div>", f"<div{self.attr('content')}><div{self.attr(None)}>{{}}</div></div>", f"<section{self.attr('content')}>{{}}</section>", f"<div{self.attr(None)}>{{}}</div>", "{}"]).format(body + inner)
        parts = [core]
        if r.random() < 0.35:
            parts.insert(r.randint(0, 1), self.side())
            if r.random() < 0.5:
                parts = [f"<div{self.attr(None)}>{''.join(parts)}</div>"]
        for chance, make in ((0.5, self.advert), (0.25, self.notice)):
            if r.random() < chance:
                parts.insert(0, make())
        if r.random() < 0.9:
            parts.insert(0, self.top())
        for chance, make in ((0.3, self.comments), (0.2, self.form), (0.2, self.side), (0.15, self.notice), (0.9, self.foot)):
            if r.random() < chance:
                parts.append(make())
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 9)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{''.join(parts)}{r.choice(['</body></html>', ''])}"


def made_page(seed: int) -> tuple[str, Page, np.ndarray]:
    """HTML, its tree and the labels of the nodes: does the node hold main text?"""
    source = _Maker(seed).page()
    page = parse(source)
    label = np.array([t.startswith(_MARK) for t in page.text])
    page.text = [t.replace(_MARK, "") for t in page.text]
    for i in range(len(label) - 1, 0, -1):
        label[page.parent[i]] |= label[i]
    return source.replace(_MARK, ""), page, label


@lru_cache(1)
def trained_model(pages: int = 800, seed: int = 11) -> BoostedTrees:
    """Trees fitted on made-up pages; the same for the same arguments."""
    made = [made_page(seed * 1_000_000 + k)[1:] for k in range(pages)]
    x, y = np.concatenate([node_features(p) for p, _ in made]), np.concatenate([label for _, label in made]).astype(float)
    return BoostedTrees().fit(x, y)


#: Nodes that have feature rows at a time.
_SLICE = 50_000


def extract(sources: list[str], model: BoostedTrees) -> list[str]:
    """Main texts of some pages."""
    out: list[str] = []
    waiting: list[Page] = []

    def score() -> None:
        if waiting:
            odds = model.log_odds(np.concatenate([node_features(t) for t in waiting]))
            ends = np.cumsum([len(t.tag) for t in waiting])
            out.extend(main_text(t, o) for t, o in zip(waiting, np.split(odds, ends[:-1])))
            waiting.clear()

    for source in sources:
        page = parse(source)
        if len(page.tag) + sum(len(t.tag) for t in waiting) > _SLICE:
            score()
        if len(page.tag) > _SLICE:
            rows = feature_rows(page)
            out.append(main_text(page, np.concatenate([model.log_odds(rows(a, a + _SLICE)) for a in range(0, len(page.tag), _SLICE)])))
        else:
            waiting.append(page)
    score()
    return out


def extract_main_text(df: DataFrame, id_col: str, html_col: str, keep: tuple[str, ...] = (), model: BoostedTrees | None = None) -> DataFrame:
    """(id, *keep, text, n_chars) of every row; ``text`` is empty if there is none.

    Blocks in page order joined by one ``\\n``, white space inside a block as one
    space, character references decoded.  Null html counts as empty; repeated rows
    give a result each; an empty table gives none.  Kept columns named as one of the
    results get a ``_`` appended.  A page of 10 MB needs under 1 GB.  The model
    (50 trees) is broadcast; no shuffle.
    """
    names = ["page_id"]
    for name in keep:
        while name.lower() in {"text", "n_chars", "_html", *(x.lower() for x in names)}:
            name += "_"
        names.append(name)
    plain = df.select(*[c.alias(n) for c, n in zip([df[f"`{id_col}`"], *[df[f"`{k}`"] for k in keep]], names)], df[f"`{html_col}`"].alias("_html"))
    sent = df.sparkSession.sparkContext.broadcast(model or trained_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str] = []
            for some in groups(batch.column("_html"), 1_500_000):
                found += extract(some, sent.value)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[*names, "text", "n_chars"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema[:-1])
    return plain.mapInArrow(run, f"{kinds}, text string, n_chars long")
