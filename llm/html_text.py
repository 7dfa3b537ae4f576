"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of block elements with text units.  Each block gets features of
its subtree (text, links, density of tags, sentence marks), its attribute tokens and
those of its ancestors, its depth and its siblings.  Gradient-boosted trees give the
chance that its text is article text.  A dynamic programme then labels whole subtrees:
a block is kept whole, dropped whole, or mixed with each child labelled in turn, so no
kept block lies in a dropped one.

No page of the data says what its article is, so the trees are fitted on pages that
``page_maker`` writes with known articles: ``TRAIN_PAGES`` of them, from a fixed seed.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import bound_batches, table, with_field

# Element names of HTML by how they behave.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe noembed noframes xmp".split())
#: Dropped with what is in them if they are closed; if not, up to the first block.
DRAWN = set("svg select".split())
BLOCK = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "legend li main menu nav ol p pre search section summary table caption colgroup thead tbody tfoot tr td th ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup", "legend", "li", "dd", "dt"} | {"li", "dd", "dt"}
#: What an opening element ends, up to the containers it must not leave.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

# Attribute tokens by what they hint at.
HINTS = {
    "menu": set("nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs tabs pagination pager topbar toc skip sitemap".split()),
    "edge": set("header masthead footer foot bottom top copyright colophon legal banner contentinfo branding logo site credits".split()),
    "side": set("side sidebar aside rail column widget widgets complementary related recommended recommendations trending popular teaser teasers more latest tags".split()),
    "ad": set("ad ads advert advertisement advertising adbox adslot sponsor sponsored promo promotion banner-ad dfp outbrain taboola affiliate".split()),
    "notice": set("notice notices alert cookie cookies consent gdpr warning popup modal overlay message announcement disclaimer paywall subscribe subscription newsletter signup".split()),
    "talk": set("comment comments commentlist disqus reply replies respond discussion reviews feedback thread".split()),
    "form": set("form search login register share sharing social buttons button toolbar tools meta byline contact".split()),
    "text": set("article content main post entry story text body articlebody entry-content post-content prose page-content hentry".split()),
}
ROLES = {"navigation": "menu", "banner": "edge", "contentinfo": "edge", "complementary": "side", "search": "form", "form": "form", "alert": "notice", "dialog": "notice", "main": "text", "article": "text"}
TAG_KINDS = ["p", "heading", "list", "li", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "quote", "figure", "other"]
KIND_OF = {**{f"h{k}": "heading" for k in range(1, 7)}, "hgroup": "heading", "ul": "list", "ol": "list", "dl": "list", "menu": "list", "dt": "li", "dd": "li", "blockquote": "quote", "pre": "quote", "figcaption": "figure", "fieldset": "form", "search": "form", **{t: "table" for t in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption")}}
KIND_NO = {k: i for i, k in enumerate(TAG_KINDS)}
HINT_NO = {k: i for i, k in enumerate(HINTS)}
TAG_HINT = {t: 1 << HINT_NO[k] for t, k in {"nav": "menu", "header": "edge", "footer": "edge", "aside": "side", "form": "form", "search": "form", "article": "text", "main": "text"}.items()}
HINT_OF_TOKEN = {t: i for k, i in HINT_NO.items() for t in HINTS[k]}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r""">|=\s*["']""")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I) for t in RAW | DRAWN}
_BLOCK_TAG = re.compile(f"</?(?:{'|'.join(sorted(BLOCK))})(?=[\\s/>])", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    """One block element."""

    __slots__ = ("tag", "parent", "depth", "hints", "hidden", "children", "units", "links", "inline", "end")

    def __init__(self, tag: str, parent: int, depth: int, hints: int, hidden: bool):
        self.tag, self.parent, self.depth, self.hints, self.hidden = tag, parent, depth, hints, hidden
        self.children: list[int] = []
        self.units: list[int] = []
        self.links = self.inline = self.end = 0


def _hints(raw: str) -> tuple[int, bool]:
    """Bits of the hints of class, id and role, and whether the element is hidden."""
    bits, hidden = 0, False
    if raw and not raw.isspace():
        for m in _ATTR.finditer(raw):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name in ("class", "id", "itemprop", "aria-label"):
                for token in _SPLIT.split(html.unescape(value)):
                    k = HINT_OF_TOKEN.get(token)
                    if k is not None:
                        bits |= 1 << k
            elif name == "role":
                k = ROLES.get(value)
                bits |= 1 << HINT_NO[k] if k else 0
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                hidden = True
    return bits, hidden


class _Open:
    """The open elements as a stack of (tag, block), and where the last of each tag stands."""

    def __init__(self):
        self.stack: list[tuple[str | None, int]] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, block: int) -> None:
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, block))

    def last(self, *tags: str) -> int:
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=-1)

    def cut(self, k: int) -> None:
        """Close everything from place ``k``."""
        while len(self.stack) > k:
            tag, _ = self.stack.pop()
            if tag is not None:
                self.at[tag].pop()
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def drop(self, tag: str) -> None:
        """Close the last ``tag``, an inline element, and leave what is open in it."""
        self.stack[self.at[tag].pop()] = (None, self.stack[-1][1])
        while self.stack[-1][0] is None:
            self.stack.pop()

    def links(self) -> bool:
        return bool(self.at.get("a"))


def _tag_end(page: str, at: int, unpaired: set[str]) -> int:
    """Where the tag ends whose name ends at ``at``: past its ``>``, or -1.

    A quote after an equals sign holds up to its pair; one without a pair is as any letter.
    """
    while m := _STOP.search(page, at):
        if m.group() == ">":
            return m.end()
        quote, at = m.group()[-1], m.end()
        end = -1 if quote in unpaired else page.find(quote, at)
        if end < 0:
            unpaired.add(quote)
        else:
            at = end + 1
    return -1


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes in page order and (node, text) units; tolerant of bad nesting.

    One pass: every character is looked at a fixed number of times, and the open elements
    are found by their last places, so time grows with the length of the page alone.
    """
    nodes = [Node("html", -1, 0, 0, False)]
    units: list[tuple[int, str]] = []
    open_ = _Open()
    open_.push("html", 0)
    stack, pieces, unpaired = open_.stack, [], set()

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                at = stack[-1][1]
                nodes[at].units.append(len(units))
                units.append((at, text))
            pieces.clear()

    def close(k: int) -> None:
        flush()
        open_.cut(k)

    def add(text: str) -> None:
        pieces.append(text)
        if open_.links():
            nodes[stack[-1][1]].links += len(text)

    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark != at:
            add(page[at:] if mark < 0 else page[at:mark])
        if mark < 0:
            break
        sign = page[mark + 1 : mark + 2]
        ends = sign == "/"
        name = _NAME.match(page, mark + 1 + ends)
        if name is None:
            if page.startswith("<!--", mark):
                end = page.find("-->", mark + 4)
                at = size if end < 0 else end + 3
            elif sign and sign in "!?/":
                end = page.find(">", mark)
                at = size if end < 0 else end + 1
            else:
                add("<")
                at = mark + 1
            continue
        at = _tag_end(page, name.end(), unpaired)
        if at < 0:
            break  # a tag cut off by the end
        tag = name.group().lower()
        if ends:
            k = open_.last(tag)
            if k > 0 and tag in BLOCK:
                close(k)
            elif k > 0 and open_.blocks[-1] < k:
                open_.drop(tag)
            continue
        attributes = page[name.end() : at - 1]
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag in DRAWN:
            if not attributes.endswith("/"):
                end = None if tag in unpaired else _RAW_END[tag].search(page, at)
                if end is None:
                    unpaired.add(tag)
                    end = _BLOCK_TAG.search(page, at)
                    at = end.start() if end else size
                else:
                    at = end.end()
            continue
        if tag in VOID:
            if tag == "br":
                add(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in CLOSES_P:
            k = open_.last("p")
            if k > open_.last("td", "th", "table", "button"):
                close(k)
        if tag in ENDS:
            what, within = ENDS[tag]
            inside = open_.last(*within)
            # What is open inside the container: the outermost goes for rows, so cells go with them.
            k = open_.last(*what)
            if k > inside:
                if tag == "tr" and open_.last("tr") > inside:
                    k = min(k, open_.last("tr"))
                close(k)
        if tag not in BLOCK:
            nodes[stack[-1][1]].inline += 1
            open_.push(tag, stack[-1][1])
            continue
        flush()
        if tag == "html":
            continue
        parent = stack[-1][1]
        bits, hidden = _hints(attributes)
        nodes[parent].children.append(len(nodes))
        open_.push(tag, len(nodes))
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, bits, hidden))
    close(1)
    flush()
    return nodes, units


N_FEATURES = len(TAG_KINDS) + 3 * len(HINTS) + 20


def node_features(nodes: list[Node], units: list[tuple[int, str]]) -> np.ndarray:
    """A row of features for each node."""
    n, h, t = len(nodes), len(HINTS), len(TAG_KINDS)
    out = np.zeros((n, N_FEATURES), np.float32)
    parent = [x.parent for x in nodes]
    text, words, marks = [0] * n, [0] * n, [0] * n
    for at, s in units:
        text[at] += len(s)
        words[at] += s.count(" ") + 1
        marks[at] += s.count(".") + s.count(",") + s.count("?") + s.count("!")
    links, tags, paras = [x.links for x in nodes], [1 + x.inline for x in nodes], [int(x.tag == "p") for x in nodes]
    own = np.array(text, np.float64)
    seen, above = [0] * n, [0] * n
    for k, x in enumerate(nodes):
        above[k] = seen[parent[k]] if k else 0
        seen[k] = x.hints | TAG_HINT.get(x.tag, 0) | above[k]
    below = [0] * n
    for k in range(n - 1, 0, -1):
        p = parent[k]
        below[p] |= seen[k]
        text[p] += text[k]
        words[p] += words[k]
        marks[p] += marks[k]
        links[p] += links[k]
        tags[p] += tags[k]
        paras[p] += paras[k]
    text, words, marks, links, tags, paras = (np.array(a, np.float64) for a in (text, words, marks, links, tags, paras))
    kinds = np.array([KIND_NO.get(KIND_OF.get(x.tag, x.tag), KIND_NO["other"]) for x in nodes])
    out[np.arange(n), kinds] = 1
    base = t
    for bits in (np.array([x.hints for x in nodes]), np.array(above), np.array(below)):
        for b in range(h):
            out[:, base + b] = bits >> b & 1
        base += h
    size, total = np.maximum(1.0, text), max(1.0, text[0])
    before = np.concatenate(([0.0], np.cumsum(own)[:-1]))
    depth, hidden = np.array([x.depth for x in nodes]), np.array([x.hidden for x in nodes])
    out[:, base : base + 12] = np.stack((np.log1p(text), np.log1p(own), np.log1p(words), links / size, tags / size, marks / size, text / np.maximum(1, words), np.log1p(paras), text / total, before / total, depth, hidden), axis=1)
    base += 12
    # Siblings: children of one node after another, in page order.
    child = np.array([c for x in nodes for c in x.children], np.int64)
    if len(child):
        of = np.array(parent)[child]
        many = np.bincount(of, minlength=n)[of]
        start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        place = np.arange(len(child)) - np.repeat(start, np.diff(np.append(start, len(child))))
        pair, same = np.unique(of * t + kinds[child], return_inverse=True, return_counts=True)[1:]
        mean = np.bincount(of, text[child], n)[of] / many
        left, right = np.zeros(len(child)), np.zeros(len(child))
        left[1:], right[:-1] = text[child[:-1]] * (place[1:] > 0), text[child[1:]] * (place[1:] > 0)
        out[child, base : base + 8] = np.stack((place, many - place, many, same[pair], text[child] / np.maximum(1.0, mean), np.log1p(mean), left, right), axis=1)
    return out


class Boosted:
    """Gradient-boosted trees for a yes/no label on binned features."""

    BINS, DEPTH, TREES, RATE, LEAST, SMOOTH = 32, 4, 60, 0.2, 20, 1.0

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.BINS + 1)[1:-1])) for c in x.T]
        bins = self._binned(x)
        rate = np.clip((y * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(bins, (y - p) * weight, p * (1 - p) * weight)
            self.trees.append(tree)
            score += self._walk(tree, bins)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1).astype(np.uint8)

    def _grow(self, bins, grad, hess):
        """A full tree: feature and border for each inner place, value for each leaf."""
        feature = np.zeros(2**self.DEPTH - 1, np.int64)
        border = np.full(2**self.DEPTH - 1, 255, np.int64)
        at = np.zeros(len(bins), np.int64)
        b = self.BINS + 1
        for level in range(self.DEPTH):
            nodes = 2**level
            best = np.zeros(nodes)
            local = at - (nodes - 1)
            g0, h0 = np.bincount(local, grad, nodes), np.bincount(local, hess, nodes)
            for f in range(bins.shape[1]):
                key = local * b + bins[:, f]
                g = np.bincount(key, grad, nodes * b).reshape(nodes, b).cumsum(axis=1)
                h = np.bincount(key, hess, nodes * b).reshape(nodes, b).cumsum(axis=1)
                m = np.bincount(key, minlength=nodes * b).reshape(nodes, b).cumsum(axis=1)
                gain = g**2 / (h + self.SMOOTH) + (g0[:, None] - g) ** 2 / (h0[:, None] - h + self.SMOOTH) - (g0**2 / (h0 + self.SMOOTH))[:, None]
                gain[(m < self.LEAST) | (m[:, -1:] - m < self.LEAST)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(nodes), k]
                for i in np.flatnonzero(top > best + 1e-9):
                    best[i], feature[nodes - 1 + i], border[nodes - 1 + i] = top[i], f, k[i]
            at = 2 * at + 1 + (bins[np.arange(len(bins)), feature[at]] > border[at])
        leaf = at - (2**self.DEPTH - 1)
        n = 2**self.DEPTH
        value = self.RATE * np.bincount(leaf, grad, n) / (np.bincount(leaf, hess, n) + self.SMOOTH)
        return feature, border, value

    def _walk(self, tree, bins):
        feature, border, value = tree
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.DEPTH):
            at = 2 * at + 1 + (bins[rows, feature[at]] > border[at])
        return value[at - (2**self.DEPTH - 1)]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        bins = self._binned(x)
        return self.start + sum(self._walk(t, bins) for t in self.trees)


MIXED_COST = 0.25


def decode(nodes: list[Node], units: list[tuple[int, str]], odds: np.ndarray) -> np.ndarray:
    """Which units are kept: the best labelling of subtrees as kept, dropped or mixed."""
    n = len(nodes)
    own = np.zeros(n)
    for at, s in units:
        own[at] += len(s)
    weight = np.where(own > 0, 1 + np.log1p(own) / 4, 0.25)
    yes = -np.logaddexp(0, -odds) * weight
    no = -np.logaddexp(0, odds) * weight
    keep, drop, free = yes.copy(), no.copy(), np.zeros(n)
    best = np.zeros(n)
    label = np.zeros(n, np.int8)
    for k in range(n - 1, -1, -1):
        mixed = -np.inf
        if nodes[k].children:
            mixed = free[k] - MIXED_COST + (max(yes[k], no[k]) if own[k] else 0.0)
        if nodes[k].hidden:
            keep[k] = mixed = -np.inf
        options = (drop[k], keep[k], mixed)
        label[k] = int(np.argmax(options))
        best[k] = options[label[k]]
        p = nodes[k].parent
        if p >= 0:
            keep[p] += keep[k]
            drop[p] += drop[k]
            free[p] += best[k]
    final = label.copy()
    for k in range(1, n):
        if final[nodes[k].parent] != 2:
            final[k] = final[nodes[k].parent]
    return np.array([final[at] == 1 or (final[at] == 2 and odds[at] > 0) for at, _ in units], bool)


# Pages with known articles ------------------------------------------------------------

TRAIN_PAGES = 500


class page_maker:
    """Writes pages; units of the article begin with a mark that no other text has."""

    MARK = "␟"

    def __init__(self, seed: int):
        self.r = np.random.RandomState(seed)
        self.vocabulary = ["".join(self.r.choice(list("aeioubcdfgklmnprstvwz"), self.r.randint(2, 9))) for _ in range(800)]

    def some(self, p: float) -> bool:
        return self.r.rand() < p

    def pick(self, *options: str) -> str:
        return options[self.r.randint(len(options))]

    def words(self, low: int, high: int) -> str:
        return " ".join(self.vocabulary[i] for i in self.r.randint(0, 800, self.r.randint(low, high + 1)))

    def prose(self, low: int = 1, high: int = 8) -> str:
        return " ".join(self.words(1, 25).capitalize() + self.pick(".", ".", ".", "?", ",") for _ in range(self.r.randint(low, high + 1)))

    def attr(self, *names: str) -> str:
        if self.some(0.2):
            return ""
        name = self.pick(*names)
        if self.some(0.3):
            name = self.pick("c-", "js ", "block ", "main-wrap ", "x_") + name
        return f' {self.pick("class", "class", "id")}="{name}"'

    def links(self, n: int, tag: str = "ul") -> str:
        items = "".join(f'<li><a href="/{i}">{self.words(1, 4)}</a>' + "</li>" * self.some(0.9) for i in range(n))
        return f"<{tag}>{items}</{tag}>" if self.some(0.8) else "".join(f'<a href="#">{self.words(1, 3)}</a> ' for _ in range(n))

    def box(self, tag: str, attr: str, body: str) -> str:
        return f"<{tag}{attr}>{body}</{tag}>"

    def menu(self) -> str:
        return self.box(self.pick("nav", "nav", "div", "ul"), self.attr("nav", "menu", "breadcrumbs", "navbar"), self.links(self.r.randint(2, 9)))

    def head(self) -> str:
        return self.box(self.pick("header", "header", "div"), self.attr("header", "masthead", "site-header", "topbar"), self.pick(f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 8)}</p>", f"<div>{self.words(1, 3)}</div>") + (self.menu() if self.some(0.5) else ""))

    def ad(self) -> str:
        return self.box(self.pick("div", "div", "aside", "p", "section"), self.pick(' class="ad"', ' class="ads"', ' class="advert"', ' id="ad-1"', ' class="sponsored"', ' class="promo box"'), self.pick(self.prose(1, 2), f"<p>{self.prose(1, 2)}</p>", f'<a href="#">{self.words(3, 9)}</a>'))

    def notice(self) -> str:
        return self.box(self.pick("div", "div", "section", "p"), self.attr("cookie-notice", "notice", "alert", "consent", "newsletter", "popup", "paywall"), self.pick(self.prose(1, 3), f"<p>{self.prose(1, 2)}</p><button>{self.words(1, 2)}</button>"))

    def side(self) -> str:
        return self.box(self.pick("aside", "aside", "div"), self.attr("sidebar", "related", "widget", "rail", "popular"), f"<h3>{self.words(1, 3)}</h3>" + self.pick(self.links(5), f"<p>{self.prose(1, 2)}</p>", "".join(f"<p>{self.prose(1, 2)}</p>" for _ in range(3))))

    def form(self) -> str:
        return f'<form{self.attr("search", "contact-form", "login", "subscribe")}><label>{self.words(1, 4)}</label><input name="q"><p>{self.words(2, 10)}</p><button>{self.words(1, 2)}</button></form>'

    def talk(self) -> str:
        one = lambda: self.box(self.pick("div", "li", "article", "section"), self.attr("comment", "reply", "comment-body"), f"<b>{self.words(1, 2)}</b><p>{self.prose(1, 4)}</p>")
        return self.box(self.pick("section", "div", "ol"), self.pick(' id="comments"', ' class="comments"', ' class="commentlist"', ' class="discussion"', ' class="reviews"'), f"<h2>{self.words(1, 2)}</h2>" * self.some(0.6) + "".join(one() for _ in range(self.r.randint(1, 6))))

    def foot(self) -> str:
        return self.box(self.pick("footer", "footer", "div"), self.attr("footer", "site-footer", "colophon", "copyright"), self.pick(f"&copy; {self.words(1, 3)} &middot; {self.prose(1, 1)}", f"<p>{self.prose(1, 2)}</p>" + self.links(4), self.links(6)))

    def paragraph(self, tag: str = "p") -> str:
        text = self.MARK + self.prose(1, self.pick_size())
        if self.some(0.2):
            cut = len(text) // 2
            text = text[:cut] + f'<a href="#">{self.words(1, 3)}</a> <em>{self.words(1, 2)}</em> ' + text[cut:]
        if tag == "p" and self.some(0.15):
            return f"<p><b>{text}<br>"
        return f"<{tag}>{text}" + f"</{tag}>" * (tag != "p" or self.some(0.9))

    def pick_size(self) -> int:
        return int(self.r.choice([1, 2, 5, 12, 25]))

    def article(self) -> str:
        tag, attr = [("article", ""), ("article", self.attr("post", "story")), ("main", ""), ("div", self.pick(' class="content"', ' id="main"', ' class="entry-content"', ' class="post"', ' class="article-body"')), ("section", self.attr("content", "text")), ("div", "")][self.r.choice(6, p=[0.35, 0.15, 0.12, 0.2, 0.1, 0.08])]
        parts = [f"<h1>{self.MARK}{self.words(2, 12)}</h1>"] if self.some(0.8) else []
        plain = "div" if self.some(0.1) else "p"
        for _ in range(self.r.randint(1, 14)):
            roll = self.r.rand()
            if roll < 0.78:
                parts.append(self.paragraph(plain))
            elif roll < 0.84:
                parts.append(f"<h{self.r.randint(2, 5)}>{self.MARK}{self.words(1, 7)}</h2>")
            elif roll < 0.9:
                parts.append("<ul>" + "".join(f"<li>{self.MARK}{self.words(2, 15)}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>")
            elif roll < 0.93:
                parts.append(f"<blockquote><p>{self.MARK}{self.prose(1, 3)}</p></blockquote>")
            elif roll < 0.95:
                parts.append("<table>" + "".join(f"<tr><td>{self.MARK}{self.words(1, 3)}</td><td>{self.MARK}{self.words(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
            elif roll < 0.97:
                parts.append(f"<pre>{self.MARK}{self.words(3, 20)}</pre>")
            else:
                parts.append(self.pick(self.ad(), self.side(), self.notice(), self.form()))
        if self.some(0.12):
            parts.append(self.talk())
        if self.some(0.1):
            parts.insert(0, self.box("header" if self.some(0.5) else "div", self.attr("byline", "meta", "share", "social"), self.words(2, 6)))
        if self.some(0.1):
            parts.append(self.box("footer" if self.some(0.4) else "div", self.attr("related", "share", "tags"), self.links(4)))
        return self.box(tag, attr, "".join(parts))

    def page(self) -> str:
        top = [f() for f, p in ((self.head, 0.5), (self.menu, 0.8), (self.notice, 0.3), (self.ad, 0.5), (self.form, 0.2)) if self.some(p)]
        tail = [f() for f, p in ((self.side, 0.4), (self.talk, 0.35), (self.ad, 0.3), (self.form, 0.25), (self.notice, 0.2), (self.foot, 0.9)) if self.some(p)]
        if self.some(0.2):
            tail.insert(0, tail.pop(self.r.randint(len(tail)))) if tail else None
        if self.some(0.3):
            self.r.shuffle(top)
        body = "".join(top) + self.article() + "".join(tail)
        for _ in range(self.r.randint(0, 3)):
            body = self.box("div", self.attr("wrapper", "page", "container", "layout", "content-wrap"), body)
        text = f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style></head><body>{body}</body></html>"
        return text[: int(len(text) * self.r.uniform(0.5, 1))] if self.some(0.12) else text


@lru_cache(maxsize=1)
def model(pages: int = TRAIN_PAGES) -> Boosted:
    """Trees fitted on made pages."""
    maker = page_maker(31)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        nodes, units = parse(maker.page())
        good, size = np.zeros(len(nodes)), np.zeros(len(nodes))
        for at, s in units:
            good[at] += len(s) * s.startswith(maker.MARK)
            size[at] += len(s)
        for k in range(len(nodes) - 1, 0, -1):
            good[nodes[k].parent] += good[k]
            size[nodes[k].parent] += size[k]
        plain = [(at, s.replace(maker.MARK, "")) for at, s in units]
        told = size > 0
        share = good / np.maximum(size, 1)
        xs.append(node_features(nodes, plain)[told])
        ys.append((share >= 0.5)[told].astype(float))
        ws.append(np.where(np.abs(share - 0.5) > 0.4, 1.0, 0.3)[told])
    return Boosted(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


def main_texts(pages: list[str | None], trees: Boosted) -> list[str]:
    """The main text of each page, blocks joined by a line feed; empty for null."""
    parsed = [parse(p or "") for p in pages]
    if not parsed:
        return []
    odds = trees.log_odds(np.concatenate([node_features(*x) for x in parsed]))
    out, at = [], 0
    for nodes, units in parsed:
        kept = decode(nodes, units, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(s for (_, s), k in zip(units, kept) if k))
    return out


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text (the main text) and n_chars instead of the html.

    * null, empty and text-less pages give the empty string; html of any length is read
      whole, in time that grows with its length alone; broken, unclosed and cut-off markup
      is read as far as it goes;
    * repeated rows get equal texts; own columns named ``text`` and ``n_chars`` are
      replaced; an empty table is fine.  No shuffle.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    kept = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    source = pages.select(*kept, html_col)
    schema = with_field(with_field(pages.select(*kept).schema, "text", T.StringType()), "n_chars", T.LongType())
    shared = spark.sparkContext.broadcast(model())  # trees of a fixed number and size

    def run(batches):
        for batch in batches:
            texts = []
            raw = batch.column(html_col).to_pylist()
            for k in range(0, len(raw), 100):
                texts += main_texts(raw[k : k + 100], shared.value)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"])

    return source.mapInArrow(run, schema)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
