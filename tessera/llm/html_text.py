"""Main text of web pages by gradient-boosted trees over DOM nodes.

A lenient parser makes a tree of the block-level elements. Each node gets features: text density of its
subtree, tokens of its attributes, depth, sibling statistics. Boosted trees, trained here on pages
that a generator lays out and labels, give each node log-odds of belonging to the main text. Decoding picks the
set of nodes with the largest total in which no kept node has a dropped ancestor.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

BLOCKS = frozenset(
    "address article aside blockquote body button dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "label li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their end tag; without one, the first two take the rest of the page.
RAW = frozenset("script style title textarea iframe".split())
#: Elements whose content is markup, but no text of the page; without an end tag they are empty. The first two may end in themselves.
HIDDEN = frozenset("svg math template noscript object canvas audio video".split())
#: Inline elements that, like blocks, can't stand in svg or math: their start ends these.
OUTSIDE = frozenset("b big center code em font i img nobr ruby s small span strong strike sub sup tt u var".split())
#: What an element's start ends: the open elements of these names, up to a boundary.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"),
}
BOUNDS = frozenset("ul ol dl table select article section div aside nav body html".split())
#: Attribute tokens that tell what an element is for, as a generator or an author would name it.
BAD_TOKENS = "ad ads advert banner sponsor promo nav menu breadcrumb foot footer header masthead side sidebar widget related share social cookie notice consent popup modal newsletter subscribe comment comments reply login search form copyright toolbar pagination tags meta skip".split()
GOOD_TOKENS = "article content main post entry body story text page prose".split()
TAGS = "article main section div p h1 h2 h3 ul ol li nav header footer aside form table tr td blockquote pre figure button label a body html".split()

#: Pages whose nodes go through the trees together.
TOGETHER = 128

_START = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|[!?/])")
_PLAIN = re.compile(r"[^>\"']*+")
_ATTRIBUTES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKENS = re.compile(r"[a-z]+")
_SPACED = re.compile(r"[^\s]+")


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None
    tokens: frozenset[str] = frozenset()  # whole attribute tokens
    parts: frozenset[str] = frozenset()  # and runs of letters of those that are no run of letters themselves
    depth: int = 0
    children: list[Node] = field(default_factory=list)
    own: int = 0
    linked: int = 0
    commas: int = 0
    runs: int = 0
    kept: bool = False


class Tags:
    """The tags of a page, in time linear in its length: none is looked at twice, and what is missing is looked for once."""

    def __init__(self, page: str):
        self.page, self.quotes, self.last = page, {'"', "'"}, page.rfind(">")
        self.lower = page.lower() if len(page.lower()) == len(page) else "".join(c.lower() if c.isascii() else c for c in page)
        self.ends: dict[str, list[int]] = {}

    def end_of(self, at: int) -> int:
        """The place of the > that ends the tag whose name ends at `at`; -1 if there is none.

        A > in quotes ends nothing. A quote that never ends, or that only ends in a later tag's quote, counts for nothing.
        """
        page, first = self.page, -1
        if at > self.last:
            return -1
        while True:
            at = _PLAIN.match(page, at).end()
            if at >= len(page):
                return first if first >= 0 else page.find(">")  # unbalanced
            c = page[at]
            if c == ">":
                return at
            if c not in self.quotes:
                at += 1
                continue
            close = page.find(c, at + 1)
            first = first if first >= 0 else page.find(">", at)
            if close < 0:
                self.quotes.discard(c)  # there is none behind it either
                return first
            follows = page[close + 1 : close + 2]
            if first < close and follows and not follows.isspace() and follows not in "/>":
                return first
            if first < close:
                first = -1
            at = close + 1

    def after_comment(self, at: int) -> int:
        """Where the comment, declaration or the like that starts at `at` ends."""
        page = self.page
        if not page.startswith("<!--", at):
            end = page.find(">", at)
            return end + 1 if end >= 0 else len(page)
        for short in ("<!-->", "<!--->"):
            if page.startswith(short, at):
                return at + len(short)
        found = [end + len(x) for x in ("-->", "--!>") if (end := page.find(x, at + 4)) >= 0]
        return min(found, default=len(page))

    def ends_behind(self, tag: str, at: int) -> list[int]:
        """Where the end tags of this name behind `at` start, last first."""
        if tag not in self.ends:
            found = [m.start() for m in re.finditer(rf"</{re.escape(tag)}(?![^\s/>])", self.lower)]
            self.ends[tag] = found[::-1]
        ends = self.ends[tag]
        while ends and ends[-1] < at:
            ends.pop()
        return ends

    def after(self, at: int) -> int:
        end = self.page.find(">", at)
        return end + 1 if end >= 0 else len(self.page)


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements, and the page's text blocks in order, each with the node it stands in."""
    root = Node("html", None)
    node, stack, links = root, [("html", root)], 0
    hidden: list[int] = []  # places in the stack
    blocks: list[tuple[Node, str]] = []
    run: list[str] = []
    tags = Tags(page)

    def close() -> None:
        if run:
            if text := " ".join(html.unescape("".join(run)).split()):
                blocks.append((node, text))
                node.runs += 1
            run.clear()

    def text(piece: str) -> None:
        if piece and not hidden:
            run.append(piece)
            n = len(piece.strip())
            node.own += n
            node.commas += piece.count(",") + piece.count(".")
            if links:
                node.linked += n

    def pop_to(k: int) -> None:
        nonlocal node, links
        gone = stack[k:]
        if any(n is not stack[k - 1][1] for _, n in gone):
            close()
        links -= sum(t == "a" for t, _ in gone)
        del stack[k:]
        while hidden and hidden[-1] >= k:
            hidden.pop()
        node = stack[-1][1]

    at, size = 0, len(page)
    while at < size:
        m = _START.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        if not m[2]:
            at = tags.after_comment(m.start())
            continue
        end = tags.end_of(m.end())
        if end < m.end():
            break  # the page ends inside a tag
        at, tag = end + 1, m[2].lower()
        inside = stack[hidden[-1]][0] if hidden else ""
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag not in BLOCKS and stack[k][0] in BLOCKS and not (tag in HIDDEN and hidden and k > hidden[0]):
                    break  # an inline end tag does not end a block
            continue
        if tag in RAW:
            if ends := tags.ends_behind(tag, at):
                at = tags.after(ends[-1])
            elif tag in ("script", "style"):
                at = size
            continue
        if inside in ("svg", "math") and (tag in BLOCKS or tag in OUTSIDE) and all(t != "foreignobject" for t, _ in stack[hidden[-1] :]):
            pop_to(hidden[-1])
        if tag in HIDDEN or hidden:
            if tag in VOID or (tag in ("svg", "math") or inside in ("svg", "math")) and page[end - 1] == "/":
                continue
            if tag in HIDDEN:
                if len(tags.ends_behind(tag, at)) <= sum(stack[k][0] == tag for k in hidden):
                    continue  # nothing ends it: an empty element
                hidden.append(len(stack))
            stack.append((tag, node))
            continue
        if tag == "head":
            continue  # its own children are raw or void
        if tag == "br":
            run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            continue
        if tag in BLOCKS:
            ends = ENDS.get(tag, ())
            for k in range(len(stack) - 1, 0, -1):
                name = stack[k][0]
                if name in ends or name == "p" and tag not in ("button", "label", "select", "option"):
                    pop_to(k)
                    break
                if name in BOUNDS:
                    break
            close()
            if tag in ("html", "body") and any(t == tag for t, _ in stack[1:]) or tag == "html":
                continue
            written = page[m.end() : end]
            words = _SPACED.findall(" ".join(a or b or c for a, b, c in _ATTRIBUTES.findall(written)).lower()) if written else ()
            parts = {x for w in words if not w.isalpha() for x in _TOKENS.findall(w)}
            child = Node(tag, node, frozenset(words), frozenset(parts), node.depth + 1)
            node.children.append(child)
            node = child
            stack.append((tag, child))
        else:
            if tag == "a":
                links += 1
            stack.append((tag, node))
    close()
    return root, blocks


_BAD, _GOOD, _PLACE = frozenset(BAD_TOKENS), frozenset(GOOD_TOKENS), {t: float(i) for i, t in enumerate(TAGS)}
_BAD_TAGS, _GOOD_TAGS = frozenset("nav header footer aside form button select menu dialog search".split()), frozenset(("article", "main"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def features(root: Node) -> tuple[list[Node], list[int], list[tuple[float, ...]]]:
    """The nodes in page order, the place of each one's parent (-1: none), and a row of features for each."""
    nodes: list[Node] = []
    parent: list[int] = []
    waiting = [(root, -1)]
    while waiting:
        n, up = waiting.pop()
        parent.append(up)
        waiting.extend((c, len(nodes)) for c in reversed(n.children))
        nodes.append(n)
    size = len(nodes)
    own_bad, own_good = [len(n.tokens & _BAD) for n in nodes], [len(n.tokens & _GOOD) for n in nodes]
    part_bad, part_good = [len(n.parts & _BAD) for n in nodes], [len(n.parts & _GOOD) for n in nodes]
    heads = [int(n.tag in _HEADINGS) for n in nodes]
    text, linked, stops, count, paragraphs = [n.own for n in nodes], [n.linked for n in nodes], [n.commas for n in nodes], [1] * size, [int(n.tag == "p") for n in nodes]
    bad_below = list(own_bad)
    kids: list[list[int]] = [[] for _ in nodes]
    for i in range(size - 1, 0, -1):
        p = parent[i]
        kids[p].append(i)
        for total in (text, linked, stops, count, paragraphs, bad_below, heads):
            total[p] += total[i]
    page, log = max(1, text[0]), math.log1p
    above: list[tuple[int, int, int, int]] = []
    rows = []
    sibling: dict[int, tuple[int, int, float]] = {}  # by node: its index, how many share its tag, the largest text
    for group in kids:
        if group:
            alike, most = Counter(nodes[k].tag for k in group), max(text[k] for k in group)
            for at, k in enumerate(reversed(group)):
                sibling[k] = (at, alike[nodes[k].tag], most)
    for i, n in enumerate(nodes):
        p = parent[i]
        bad_tag, good_tag, bad, good = int(n.tag in _BAD_TAGS), int(n.tag in _GOOD_TAGS), own_bad[i], own_good[i]
        up = above[p] if p >= 0 else (0, 0, 0, 0)
        above.append((up[0] + bad_tag, up[1] + good_tag, up[2] + bad, up[3] + good))
        many = len(nodes[p].children) if p >= 0 else 1
        at, alike, most = sibling.get(i, (0, 1, 0))
        t, c = text[i], count[i]
        mean = text[p] / many if p >= 0 else t
        rows.append((
            _PLACE.get(n.tag, -1.0), bad_tag, good_tag, min(bad, 3), min(good, 3), *up, n.depth, log(t), t / page, linked[i] / max(1, t), stops[i] / max(1, t) * 100,
            t / c, log(c), paragraphs[i] / c, log(n.own), n.linked / max(1, n.own), len(n.children), n.runs,
            many, at / many, log(mean), t / max(1.0, mean), float(most > t), alike,
            min(part_bad[i], 3), min(part_good[i], 3), heads[i] / c, i / size, bad_below[i], t / max(1, text[p]) if p >= 0 else 1.0, float(n.tag in _HEADINGS),
        ))
    return nodes, parent, rows


@dataclass
class Trees:
    """Boosted regression trees of equal depth: at each inner node a feature and a limit, at each leaf a value."""

    start: float
    split: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        depth, trees = int(np.log2(self.leaf.shape[1])), np.arange(len(self.split))
        out = np.empty(len(x))
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            row, at = np.arange(len(part))[:, None], np.zeros((len(part), len(trees)), int)
            for _ in range(depth):
                at = 2 * at + 1 + (part[row, self.split[trees, at]] > self.limit[trees, at])
            out[lo : lo + 4096] = self.start + self.leaf[trees, at - self.split.shape[1]].sum(1)
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 24) -> Trees:
    """Trees that lower the logistic loss, by second-order gains over histograms."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    score = np.full(len(y), np.log(mean / (1 - mean)))
    start, inner = float(score[0]), (1 << depth) - 1
    splits, limits, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        split, limit, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for k in range(inner):
            here = np.flatnonzero(at == k)
            best = (1e-6, 0, 0)
            for f in range(x.shape[1]) if len(here) > 8 else ():
                gs = np.bincount(code[here, f], g[here], len(edges[f]) + 1).cumsum()
                hs = np.bincount(code[here, f], h[here], len(edges[f]) + 1).cumsum()
                gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), f, int(gain.argmax()))
            if best[0] > 1e-6:
                split[k], limit[k] = best[1], edges[best[1]][best[2]]
            at[here] = 2 * k + 1 + (x[here, split[k]] > limit[k])
        leaf = rate * np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + 1)
        score += leaf[at - inner]
        splits.append(split)
        limits.append(limit)
        leaves.append(leaf)
    return Trees(start, np.array(splits), np.array(limits), np.array(leaves))


def made_page(rng: np.random.Generator) -> str:
    """A page of made-up words. Main text is marked by a character that the trainer takes out again."""
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    words = lambda lo, hi: " ".join("".join(pick("ba", "ter", "ion", "le", "s", "un", "de", "ka", "mi", "ro") for _ in range(int(rng.integers(1, 5)))) for _ in range(int(rng.integers(lo, hi))))
    chance = lambda p: rng.random() < p

    def sentence(lo: int = 4, hi: int = 25) -> str:
        s = words(lo, hi) + pick(".", ".", "!", "")
        return s.replace(" ", ", ", 1) if chance(0.4) else s.replace(" ", pick(" &amp; ", "### ", " ", " "), 1)

    def attribute(*names: str) -> str:
        if chance(0.25):
            return ""
        name = pick(*names)
        return f' {pick("class", "id", "class")}="{pick(name, name, name + "-" + words(1, 2), words(1, 2) + " " + name)}"'

    def listing(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{words(1, 2)}">{words(1, 4)}</a></li>' if chance(0.9) else f"<li>{words(1, 5)}" for _ in range(n)) + "</ul>"

    def boilerplate() -> str:
        kind = int(rng.integers(9))
        if kind == 0:
            return f"<nav{attribute('nav', 'menu')}>{listing(int(rng.integers(1, 9)))}</nav>" if chance(0.7) else f"<div class=\"{pick('nav', 'menu', 'breadcrumb')}\">{listing(int(rng.integers(1, 9)))}</div>"
        if kind == 1:
            return f"<{(t := pick('header', 'div'))}{attribute('header', 'masthead') if t == 'header' else ' class=header'}>{pick('<h1>', '<p>', '')}{words(1, 6)}</{t}>"
        if kind == 2:
            return f"<{(t := pick('aside', 'div'))} class=\"{pick('sidebar', 'widget', 'related')}\"><h3>{words(1, 4)}</h3>{listing(3) if chance(0.5) else '<p>' + sentence(5, 40) + '</p>'}</{t}>"
        if kind == 3:
            return f"<div class=\"{pick('ad', 'ads', 'advert', 'banner', 'sponsor', 'promo')}\">{pick('', '<p>')}{sentence(3, 40)}</div>"
        if kind == 4:
            return f"<div class=\"{pick('cookie', 'notice', 'consent', 'popup')}\"><p>{sentence(5, 30)}</p><button>{words(1, 3)}</button></div>"
        if kind == 5:
            return f"<form{attribute('search', 'login', 'newsletter', 'subscribe')}><label>{words(1, 4)}</label><input><button>{words(1, 3)}</button></form>"
        if kind == 6:
            return f"<{(t := pick('section', 'div'))} {pick('class', 'id')}=\"{pick('comments', 'comment', 'reply')}\"><h2>{words(1, 3)}</h2>" + "".join(f"<{(u := pick('p', 'li', 'div'))}>{sentence(4, 60)}</{u}>" for _ in range(int(rng.integers(1, 6)))) + f"</{t}>"
        if kind == 7:
            return f"<div class=\"{pick('share', 'social', 'tags', 'pagination')}\">{listing(3)}</div>"
        return f"<div class=\"{pick('footer', 'copyright', 'meta')}\">&copy; {words(2, 12)}</div>"

    def innocent(*names: str) -> str:
        """A name of main text that has a word of boilerplate in it, such as of a section on social history."""
        bad = BAD_TOKENS[int(rng.integers(len(BAD_TOKENS)))]
        return f' {pick("class", "id", "class")}="{pick(bad + "-" + words(1, 2).replace(" ", "-"), words(1, 2).replace(" ", "-") + "-" + bad, *names)}"'

    def title() -> str:
        """A heading, at times in a header of its own, which may hold a line below it, or a menu that is none of the text."""
        head = f"<h1>\x01{sentence(2, 12)}</h1>"
        if chance(0.65):
            return head
        below = pick("", "", f"<p>\x01{sentence(3, 20)}</p>", f"<nav{attribute('nav', 'menu')}>{listing(int(rng.integers(1, 6)))}</nav>")
        return f"<header{innocent('header', 'entry-header', 'post-header', 'title') if chance(0.6) else ''}>{head}{below}</header>"

    def section() -> str:
        tag = pick("section", "section", "div")
        parts = "".join(f"<p>\x01{' '.join(sentence() for _ in range(int(rng.integers(1, 5))))}</p>" for _ in range(int(rng.integers(1, 4))))
        return f"<{tag}{innocent('section', 'chapter', 'part') if chance(0.7) else ''}><h2>\x01{words(1, 6)}</h2>{parts}</{tag}>"

    def main_text() -> str:
        out = [title()] if chance(0.85) else []
        for _ in range(int(rng.integers(1, 14)) if chance(0.9) else int(rng.integers(30, 150))):
            kind = int(rng.integers(16))
            body = " ".join(sentence() for _ in range(int(rng.integers(1, 6))))
            if kind == 0:
                out.append(f"<h2>\x01{words(1, 7)}</h2>")
            elif kind == 1:
                out.append("<ul>" + "".join(f"<li>\x01{sentence(2, 15)}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>")
            elif kind == 2:
                out.append(f"<blockquote><p>\x01{body}</p></blockquote>")
            elif kind == 3:
                out.append(f"<p><b>\x01{body}<br>")
            elif kind == 4:
                out.append(f'<p>\x01{body} <a href="/x">{words(1, 4)}</a> {sentence()}</p>')
            elif kind == 5:
                out.append("<table>" + "".join(f"<tr><td>\x01{words(1, 5)}</td><td>\x01{words(1, 5)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind == 6 and chance(0.5):
                out.append(boilerplate())
            elif kind == 7:
                out.append(section())
            else:
                out.append(f"<p>\x01{body}</p>" if chance(0.85) else f"<p>\x01{words(1, 3)}.</p>")
        inner = "".join(out)
        wrap = int(rng.integers(5))
        if wrap < 3:
            return f"<article{attribute('post', 'article', 'entry')}>{inner}</article>"
        return f"<main>{inner}</main>" if wrap == 3 else f"<div {pick('class', 'id')}=\"{pick('content', 'main', 'post', 'entry', 'story')}\">{inner}</div>"

    before, after = int(rng.integers(0, 5)), int(rng.integers(0, 4))
    body = [boilerplate() for _ in range(before)] + [main_text()] + [boilerplate() for _ in range(after)]
    if chance(0.6):
        body.append(f"<footer>&copy; {words(1, 3)} &middot; {sentence()}</footer>")
    if chance(0.3):
        body = [f"<div{attribute('wrapper', 'page', 'container')}>"] + body + ["</div>"]
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><script>var a='</p>';</script></head><body>" + "<!-- x -->".join(body) + "</body></html>"


@functools.cache
def trained(pages: int = 500, seed: int = 11) -> Trees:
    """Trees trained on generated pages. A node is main text if most text below it is."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = made_page(rng)
        marked: dict[int, list[int]] = {}
        root, blocks = parse(page)
        for node, text in blocks:
            n: Node | None = node
            while n is not None:
                counts = marked.setdefault(id(n), [0, 0])
                counts["\x01" in text] += len(text)
                n = n.parent
        plain, _ = parse(page.replace("\x01", ""))
        for row, n in zip(features(plain)[2], features(root)[0], strict=True):
            bad, good = marked.get(id(n), [0, 0])
            if bad + good:
                xs.append(row)
                ys.append(float(good > bad))
    return boost(np.array(xs), np.array(ys))


def main_texts(pages: list[str | None], trees: Trees) -> list[str]:
    """The kept blocks of each page, one a line. A null or empty page, or one without main text, gives an empty text.

    A node that is kept has kept ancestors only: the choice of nodes with the largest total log-odds under
    that rule, found from the leaves up. html and body are always open; text that stands in them directly is
    judged by their own odds.
    """
    parsed = [parse(p or "") for p in pages]
    made = [features(root) if blocks else ([], [], []) for root, blocks in parsed]
    rows = [r for _, _, x in made for r in x]
    all_odds = trees.log_odds(np.array(rows)).tolist() if rows else []
    out, lo = [], 0
    for (_, blocks), (nodes, parent, _) in zip(parsed, made, strict=True):
        odds = all_odds[lo : lo + len(nodes)]
        lo += len(nodes)
        best = list(odds)
        for i in range(len(nodes) - 1, 0, -1):
            if best[i] > 0:
                best[parent[i]] += best[i]
        keep: dict[int, bool] = {}
        for i, n in enumerate(nodes):
            is_open = n.tag in ("html", "body")
            keep[i] = is_open or best[i] > 0 and keep[parent[i]]
            n.kept = odds[i] > 0 if is_open else keep[i]
        out.append("\n".join(text for n, text in blocks if n.kept))
    return out


def main_text(page: str | None, trees: Trees | None = None) -> str:
    return main_texts([page], trees or trained())[0]


def extract(pages: DataFrame, trees: Trees | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, from its whole html.

    A null html counts as empty and gives an empty text. Null ids and urls and repeated rows pass through; an
    empty table gives no rows; other columns are not read.
    """
    trees = trees or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for lo in range(0, batch.num_rows, TOGETHER) for t in main_texts(batch.column(2).slice(lo, TOGETHER).to_pylist(), trees)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
