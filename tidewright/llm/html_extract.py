"""Main text of web pages: a tree-structured model over DOM nodes, solved by sum-product messages.

A page becomes a tree of block elements; inline markup, links among it, belongs to the block around it. Each
node is content or not. Its own evidence (element, words of class and id, role, text length, share of links)
gives it a potential, and a parent-child potential joins it to its parent. Messages go up from the leaves and
down from the root, which gives the exact marginal of every node; text of blocks whose marginal is a half or
more is the page's text. Weights of both potentials are trained by gradient on the likelihood of labelled
pages. The training pages are written by a seeded generator in this module, since no table labels page nodes:
layouts of sectioning elements, of nameless or hashed divs and of tables, with vocabularies of element, class and id
names as they are common on the web.

Elements deeper than DEEPEST become siblings of the deepest ones, as in browsers; no text is lost by that.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table
from ._words import groups

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label button map img picture source object math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template head title svg annotation annotation-xml iframe canvas audio video select textarea option".split())
#: An opening tag of the key closes open elements of the value, up to the nearest of the scope.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",)}
#: Within an element that is left out, these end an open paragraph; IMPLIED is CLOSES there, whose end tags authors may omit too.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
_TOP = ("caption", "colgroup")
IMPLIED = {**CLOSES, "tr": (*CLOSES["tr"], *_TOP), "tbody": (*CLOSES["tbody"], *_TOP), "tfoot": (*CLOSES["tfoot"], *_TOP), "thead": _TOP, "colgroup": _TOP, "option": ("option",), "optgroup": ("option", "optgroup")}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
HEAD = frozenset("head base basefont bgsound link meta title noscript noframes style script template".split())
ELEMENTS = ("html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "nav", "header", "footer", "aside", "form", "fieldset", "dl", "details", "dialog", "address", "menu", "search")
#: Words of class, id and role, by what they name.
NAMES = {
    "content": "article content entry post story body text main blog news page hentry copy prose richtext",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc tabs pagination pager topnav sitemap links skip",
    "head": "header head masthead banner topbar logo branding hero",
    "foot": "footer foot copyright legal colophon bottom credits",
    "side": "sidebar side aside rail widget widgets related recommended recommendations trending popular more teaser complementary",
    "ad": "ad ads adv advert advertisement advertising sponsor sponsored sponsors promo promotion promoted dfp adsense outbrain taboola affiliate banner-ad",
    "notice": "cookie cookies consent gdpr notice alert alertdialog popup modal overlay dialog toast paywall disclaimer banner-notice privacy warning message",
    "form": "form search searchbox login signin signup subscribe subscription newsletter register contact input",
    "social": "share sharing social follow twitter facebook like likes rating",
    "comment": "comment comments commentlist discussion reply replies respond disqus reader-comments responses thread",
    "meta": "meta byline tags tag category categories date author posted timestamp",
}
KIND_OF = {word: kind for kind, words in NAMES.items() for word in words.split()}
KINDS = tuple(NAMES)
_CUT, _GAPS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])"), re.compile(r"[ \t\n\r\f\v   -     　\u0085]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@lru_cache(100_000)
def kinds(names: str) -> tuple[int, ...]:
    """Numbers of the kinds that the words of a class, id or role name."""
    words = _CUT.split(_CAMEL.sub("-", names).lower())
    return tuple(sorted({KINDS.index(KIND_OF[w]) for w in words if w in KIND_OF}))


DEEPEST = 512


@dataclass(slots=True)
class Node:
    element: str
    parent: int
    names: tuple[int, ...]
    depth: int
    inline: bool = False
    chars: int = 0
    linked: int = 0
    marks: int = 0
    children: int = 0


class Stack:
    """Open elements, and where the last one of each name and the last block element stand."""

    def __init__(self):
        self.names: list[str] = []
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.solid: list[int] = []

    def push(self, name: str) -> None:
        self.at[name].append(len(self.names))
        if name not in INLINE:
            self.solid.append(len(self.names))
        self.names.append(name)

    def cut(self, k: int) -> None:
        for name in self.names[k:]:
            self.at[name].pop()
        while self.solid and self.solid[-1] >= k:
            self.solid.pop()
        del self.names[k:]

    def last(self, *names: str) -> int:
        return max((at[-1] for n in names if (at := self.at.get(n))), default=-1)

    def ended(self, tag: str, ends: tuple[str, ...], bounded: bool) -> int:
        """Where the start tag ends an open element of ``ends``, or -1: up to its scope if it is bounded, else only the nearest block."""
        if bounded:
            k = self.last(*ends)
            return k if k > self.last(*SCOPE.get(tag, ())) else -1
        k = self.solid[-1] if self.solid else -1
        return k if k >= 0 and self.names[k] in ends else -1

    def reaches(self, tag: str) -> int:
        """Where the element stands that an end tag ends, or -1; an inline one does not reach past a block."""
        k = self.last(tag)
        return -1 if tag in INLINE and self.solid and self.solid[-1] > k else k


class Page(HTMLParser):
    """Nodes of a page and its blocks: (node, text) in page order. A block of nothing but buttons is none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.blocks: list[tuple[int, str]] = []
        self.open, self.node_of = Stack(), []  # inline elements keep the node around them
        self.held, self.plain, self.links, self.buttons = [], False, 0, 0
        self.skipped = Stack()  # what is open within an element that is left out, that one first
        self._enter("html", (), False)

    def _push(self, element: str, node: int) -> None:
        self.open.push(element)
        self.node_of.append(node)

    def _enter(self, element: str, names: tuple[int, ...], inline: bool) -> None:
        parent = self.node_of[-1] if self.node_of else -1
        if parent >= 0 and self.nodes[parent].depth >= DEEPEST:
            parent = self.nodes[parent].parent
        if parent >= 0:
            self.nodes[parent].children += 1
        self.nodes.append(Node(element, parent, names, self.nodes[parent].depth + 1 if parent >= 0 else 0, inline))
        self._push(element, len(self.nodes) - 1)

    def _break(self) -> None:
        """The text so far is a block of the node that is open."""
        if self.held:
            text = _GAPS.sub(" ", "".join(self.held)).strip() if self.plain else ""
            if text:
                self.blocks.append((self.node_of[-1], text))
            self.held, self.plain = [], False

    def _close(self, at: int) -> None:
        if any(e not in INLINE or n != self.node_of[at - 1] for e, n in zip(self.open.names[at:], self.node_of[at:])):
            self._break()
        self.links -= self.open.names[at:].count("a")
        self.buttons -= self.open.names[at:].count("button")
        self.open.cut(at)
        del self.node_of[at:]

    def handle_starttag(self, tag, attrs):
        if self.skipped.names and not self._ends_skip(tag):
            if tag not in VOID:
                self.skipped.push(tag)
            return
        if tag in DROPPED:
            self.skipped.push(tag)
            return
        if len(self.node_of) == 1 and tag not in VOID and tag not in ("html", "body"):
            self._enter("body", (), False)  # its tags may be left out
        if tag == "br":
            self.held.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self._break()
            return
        attributes = dict(attrs)
        if tag in ("html", "body") and self.open.at[tag]:
            return
        named = () if tag in ("html", "body") else kinds(" ".join(str(attributes.get(k) or "") for k in ("class", "id", "role")))  # a body's name is the page's
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in (attributes.get("style") or "").replace(" ", "").lower()
        if tag not in INLINE:  # a block ends an open paragraph, and elements that can't nest in themselves
            ends = ("p", *CLOSES.get(tag, ()), *(HEADINGS if tag in HEADINGS else ()))
            while (k := self.open.ended(tag, ends, tag in CLOSES)) > 0:
                self._close(k)
        if hidden:
            self.skipped.push(tag)
            return
        if tag in INLINE:
            if named and tag not in ("a", "time", "button"):
                self._break()
                self._enter(tag, named, True)
            else:
                self._push(tag, self.node_of[-1])
            self.links += tag == "a"
            self.buttons += tag == "button"
            return
        self._break()
        self._enter(tag, named, False)

    def _ends_skip(self, tag: str) -> bool:
        """Whether a start tag ends what is left out; elements within that it ends are closed."""
        held = self.skipped
        if held.names[0] == "head" and (tag == "body" or (len(held.names) == 1 and tag not in HEAD)):
            held.cut(0)
            return True
        ends = (*IMPLIED.get(tag, ()), *(("p",) if tag in ENDS_P else ()))
        while ends and (k := held.ended(tag, ends, tag in IMPLIED)) >= 0:
            held.cut(k)
        return not held.names

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.skipped.names and tag not in VOID:  # it was put there just now and has no content: a closed svg, an XHTML page's script
            self.skipped.cut(len(self.skipped.names) - 1)

    def handle_endtag(self, tag):
        if self.skipped.names:
            if (k := self.skipped.last(tag)) >= 0:
                self.skipped.cut(k)
                return
            # an end tag of an element around what is left out ends that too
            if (tag in INLINE and self.skipped.last(*ELEMENTS) >= 0) or self.open.reaches(tag) <= 0:
                return
            self.skipped.cut(0)
        if (k := self.open.reaches(tag)) > 0:
            self._close(k)

    def handle_data(self, data):
        if self.skipped.names == ["head"] and data.strip():
            self.skipped.cut(0)
        if self.skipped.names:
            return
        if len(self.node_of) == 1 and data.strip():
            self._enter("body", (), False)
        self.held.append(data)
        if self.buttons:
            return
        self.plain = self.plain or not data.isspace()
        node, n = self.nodes[self.node_of[-1]], len(data) - data.count(" ")
        node.chars += n
        if self.links > 0:
            node.linked += n
        node.marks += sum(map(data.count, ".,;:!?"))

    def finish(self) -> Page:
        self.close()
        self._break()
        return self


def read_page(html: str | None) -> Page:
    page = Page()
    page.feed(html or "")
    return page.finish()


FEATURES = (
    "one", *ELEMENTS, "other", "heading", "inline", *KINDS, "no_name", "chars_0", "chars_20", "chars_80", "chars_300", "subtree_200", "subtree_1000", "linked_some", "linked_half", "linked_most", "marks", "deep", "many_children",
    "page_twentieth", "page_fifth", "page_half", "prose", "short_page", "aside_above", "named_above", "content_above", "own_header", "page_header",
)
AT = {f: k for k, f in enumerate(FEATURES)}
TEXTS = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote"))
ROWS = 50_000  # nodes whose evidence is weighed at once
SECTIONS = [AT[e] for e in ("article", "main", "section", "div")]
ASIDES = [AT[e] for e in ("nav", "header", "footer", "aside", "form", "fieldset", "dialog", "address", "menu", "search")]
NOT_CONTENT = [AT[k] for k in KINDS if k not in ("content", "head", "meta")]
SORTS = 6


def by_depth(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth, from the roots on."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 1)))


def wide(page: Page) -> list[bool]:
    """Nodes that hold so much of the page that the name or element of an aside can't be meant of all that is in them.

    That is a form around half of the plain text; anything around half of it with a main heading or element in it, or,
    but for comments, an article; and anything around most of it with several blocks of text.
    """
    nodes = page.nodes
    plain = [n.chars - n.linked for n in nodes]
    heads, articles = [n.element in ("h1", "main") for n in nodes], [n.element == "article" for n in nodes]
    texts = [int(n.element in TEXTS and n.chars > n.linked) for n in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        p = nodes[k].parent
        plain[p] += plain[k]
        texts[p] += texts[k]
        heads[p] |= heads[k]
        articles[p] |= articles[k]
    comment, out = KINDS.index("comment"), []
    for k, n in enumerate(nodes):
        part = plain[k] / max(plain[0], 1)
        comments = comment in n.names
        out.append(part > 0.5 and (n.element in ("form", "fieldset") or heads[k] or (articles[k] and not comments) or (part > 0.85 and texts[k] > 2 and not comments)))
    return out


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row of 0 and 1 a node, parents in the joined numbering or -1, depths) of some pages together."""
    nodes, parent, page_of, base = [], [], [], 0
    for k, page in enumerate(pages):
        parent += [base + n.parent if n.parent >= 0 else -1 for n in page.nodes]
        page_of += [k] * len(page.nodes)
        nodes += page.nodes
        base += len(page.nodes)
    parent, depth, page_of = np.array(parent, np.int64), np.array([n.depth for n in nodes], np.int64), np.array(page_of, np.int64)
    chars, linked, marks = (np.array([getattr(n, k) for n in nodes], float) for k in ("chars", "linked", "marks"))
    levels = by_depth(depth)
    below, below_linked, below_marks = chars.copy(), linked.copy(), marks.copy()
    for at in levels[:0:-1]:
        for total in (below, below_linked, below_marks):
            np.add.at(total, parent[at], total[at])
    x = np.zeros((len(nodes), len(FEATURES)), np.uint8)
    x[:, 0] = 1
    large = [w for page in pages for w in wide(page)]
    for k, n in enumerate(nodes):
        element, names = AT.get(n.element, AT["other"]), n.names
        if large[k]:
            element = AT["div"] if element in ASIDES else element
            names = [kind for kind in names if AT[KINDS[kind]] not in NOT_CONTENT]
        x[k, element] = 1
        x[k, AT["heading"]] = n.element in HEADINGS
        x[k, AT["inline"]] = n.inline
        for kind in names:
            x[k, AT[KINDS[kind]]] = 1
        x[k, AT["no_name"]] = not names
    share = below_linked / np.maximum(below, 1)
    plain = below - below_linked
    of_page = np.bincount(page_of, chars - linked, len(pages))[page_of] if len(nodes) else plain
    prose = (below_marks / np.maximum(below, 1) > 0.01) & (share < 0.3)
    part = plain / np.maximum(of_page, 1)
    # what a node stands in: an aside (a header is one unless content is around it), a name that is no content's, or content, at any height
    above = np.zeros((len(nodes), 3), np.uint8)
    header = x[:, AT["header"]]
    own = np.stack([x[:, [k for k in ASIDES if k != AT["header"]]].any(1), x[:, NOT_CONTENT].any(1), x[:, [AT["article"], AT["main"], AT["content"]]].any(1)], 1).astype(np.uint8) if len(nodes) else above
    for depth_, at in enumerate(levels if len(nodes) else ()):
        if depth_:
            above[at] = above[parent[at]] | own[parent[at]]
        own[at, 0] |= header[at] & (1 - above[at, 2])
    for name, value in (
        ("chars_0", chars == 0), ("chars_20", chars > 20), ("chars_80", chars > 80), ("chars_300", chars > 300), ("subtree_200", below > 200), ("subtree_1000", below > 1000), ("linked_some", share > 0.1), ("linked_half", share > 0.5), ("linked_most", share > 0.9),
        ("marks", marks / np.maximum(chars, 1) > 0.01), ("deep", depth > 5), ("many_children", np.array([n.children > 5 for n in nodes], bool)), ("page_twentieth", part > 0.05), ("page_fifth", part > 0.2), ("page_half", part > 0.5), ("prose", prose), ("short_page", of_page < 400),
        ("aside_above", above[:, 0]), ("named_above", above[:, 1]), ("content_above", above[:, 2]),
        ("own_header", header & above[:, 2]), ("page_header", header & (1 - above[:, 2])),
    ):
        x[:, AT[name]] = value
    return x, parent, depth


def sorts(x: np.ndarray) -> np.ndarray:
    """The sort of each node: section, aside or text element, with or without a name."""
    kind = np.where(x[:, SECTIONS].any(1), 1, np.where(x[:, ASIDES].any(1), 2, 0))
    return (2 * kind + (1 - x[:, AT["no_name"]].astype(int))).astype(int)


@dataclass
class TreeModel:
    """Weights of the log-potentials: of a node being content, and of parent and child by their labels and the sort of child."""

    node: np.ndarray
    pair: np.ndarray  # [sort of child][parent label][child label]

    def marginals(self, x: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(node is content), and P(parent label, child label) of each node that has a parent, by sum-product."""
        weighed = [x[k : k + ROWS] @ self.node for k in range(0, len(x), ROWS)]
        own = np.stack([np.zeros(len(x)), np.concatenate(weighed) if weighed else np.zeros(0)], 1)
        pair = self.pair[sorts(x)]
        up, levels = own.copy(), by_depth(depth)
        to_parent = np.zeros_like(own)
        for at in levels[:0:-1]:  # from the leaves: sum over the child's label
            to_parent[at] = np.logaddexp(pair[at, :, 0] + up[at, None, 0], pair[at, :, 1] + up[at, None, 1])
            np.add.at(up, parent[at], to_parent[at])
        down = np.zeros_like(own)  # what a node hears from its parent
        both = np.zeros((len(x), 2, 2))
        for at in levels[1:]:
            above = up[parent[at]] - to_parent[at] + down[parent[at]]
            joint = above[:, :, None] + pair[at]
            down[at] = np.logaddexp(joint[:, 0], joint[:, 1])
            both[at] = joint + up[at][:, None, :]
        belief = up + down
        content = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50)))
        has = parent >= 0
        top = both[has].reshape(-1, 4).max(1)[:, None, None]
        p = np.exp(both[has] - top)
        both[has] = p / p.sum((1, 2), keepdims=True)
        return content, both


def train(pages: list[Page], labels: list[np.ndarray], rounds: int = 150, rate: float = 0.1, decay: float = 2e-4) -> TreeModel:
    """Maximum likelihood by Adam: expected counts under the marginals against those of the labels."""
    x, parent, depth = features(pages)
    x = x.astype(float)
    y = np.concatenate(labels).astype(float)
    sort, has = sorts(x), parent >= 0
    seen = np.zeros((SORTS, 2, 2))
    np.add.at(seen, (sort[has], y[parent[has]].astype(int), y[has].astype(int)), 1)
    model = TreeModel(np.zeros(x.shape[1]), np.zeros((SORTS, 2, 2)))
    m, v = [np.zeros_like(model.node), np.zeros_like(model.pair)], [np.zeros_like(model.node), np.zeros_like(model.pair)]
    for step in range(1, rounds + 1):
        content, both = model.marginals(x, parent, depth)
        expected = np.zeros((SORTS, 2, 2))
        np.add.at(expected, sort[has], both[has])
        grads = [x.T @ (y - content) / len(y) - decay * model.node, (seen - expected) / len(y) - decay * model.pair]
        for w, g, mm, vv in zip((model.node, model.pair), grads, m, v):
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            w += rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
    return model


class Writer:
    """Writes labelled pages: every element it opens is content or not, by where it stands."""

    def __init__(self, seed: int):
        self.rng, self.labels, self.out = np.random.default_rng(seed), [False], []

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def words(self, low: int, high: int, marks: bool = True) -> str:
        n = int(self.rng.integers(low, high + 1))
        out = ["".join(self.pick(("an", "be", "ti", "or", "lo", "sen", "ka", "er")) for _ in range(int(self.rng.integers(1, 4)))) for _ in range(n)]
        return " ".join(out) + ("." if marks else "")

    def name(self, kind: str | None, chance: float = 1.0) -> str:
        if kind is None or self.rng.random() > chance:
            return ""
        word, kind_of = self.pick(NAMES[kind].split()), self.pick(("class", "id", "class"))
        return f' {kind_of}="{self.pick(("{}", "{}", "site-{}", "{}-box", "{}_1", "js-{}")).format(word)}"'

    def open(self, element: str, content: bool, kind: str | None = None, chance: float = 1.0) -> None:
        self.out.append(f"<{element}{self.name(kind, chance)}>")
        self.labels.append(content)

    def leaf(self, element: str, content: bool, text: str, kind: str | None = None) -> None:
        self.open(element, content, kind)
        self.out.append(f"{text}</{element}>")

    def links(self, element: str, kind: str) -> None:
        self.open(element, False, kind, 0.7 if element in ("nav", "footer", "aside") else 1.0)
        if self.rng.random() < 0.6:
            self.open("ul", False)
            for _ in range(int(self.rng.integers(2, 9))):
                self.leaf("li", False, f'<a href="/">{self.words(1, 4, False)}</a>')
            self.out.append("</ul>")
        else:
            self.out.append(" ".join(f'<a href="/">{self.words(1, 3, False)}</a>' for _ in range(int(self.rng.integers(2, 7)))))
        self.out.append(f"</{element}>")

    def boilerplate(self) -> None:
        kind = self.pick(("nav", "side", "ad", "ad", "notice", "form", "social", "comment", "foot", "head", "meta_form"))
        element = {"nav": ("nav", "div", "ul"), "side": ("aside", "div", "section"), "ad": ("div", "aside", "section"), "notice": ("div", "section", "dialog"), "form": ("form", "div"), "social": ("div",), "comment": ("section", "div"), "foot": ("footer", "div"), "head": ("header", "div"), "meta_form": ("form",)}[kind]
        element = self.pick(element)
        if kind in ("nav", "social") and element != "ul":
            return self.links(element, kind)
        self.open(element, False, "form" if kind == "meta_form" else kind, 0.5 if element in ("nav", "aside", "footer", "header", "form", "dialog") else 1.0)
        if element == "ul":
            for _ in range(4):
                self.leaf("li", False, f'<a href="/">{self.words(1, 3, False)}</a>')
        elif self.rng.random() < 0.4:
            self.out.append(self.words(3, 30))
        else:
            if self.rng.random() < 0.5:
                self.leaf(self.pick(("h2", "h3", "h1" if kind == "head" else "h2")), False, self.words(1, 8, False))
            for _ in range(int(self.rng.integers(1, 4))):
                if kind == "comment" and self.rng.random() < 0.7:
                    self.open(self.pick(("div", "article", "li")), False, self.pick(("comment", None)))
                    last = self.out[-1][1:].split(">")[0].split(" ")[0]
                    self.leaf("p", False, self.words(4, 60))
                    self.out.append(f"</{last}>")
                else:
                    self.leaf(self.pick(("p", "div", "p")), False, self.words(4, 40))
        self.out.append(f"</{element}>")

    def article(self, framed: bool) -> None:
        if self.rng.random() < 0.7:
            inside = framed and self.rng.random() < 0.3  # a header of the article's own
            if inside:
                self.open("header", True)
            self.leaf(self.pick(("h1", "h1", "h2")), True, self.words(2, 12, False))
            self.out.append("</header>" * inside)
        for _ in range(int(self.rng.integers(1, 12))):
            r = self.rng.random()
            if r < 0.52:
                self.leaf("p", True, self.words(*self.pick(((1, 3), (5, 30), (20, 120)))))
            elif r < 0.60:
                self.leaf(self.pick(("h2", "h3")), True, self.words(1, 7, False))
            elif r < 0.67:
                kind = self.pick(("ul", "ol"))
                self.open(kind, True)
                for _ in range(int(self.rng.integers(1, 6))):
                    self.leaf("li", True, self.words(1, 20))
                self.out.append(f"</{kind}>")
            elif r < 0.71:
                self.open("blockquote", True)
                self.leaf("p", True, self.words(5, 50))
                self.out.append("</blockquote>")
            elif r < 0.74:
                self.leaf("pre", True, self.words(2, 30, False))
            elif r < 0.77:
                self.open("table", True)
                self.open("tr", True)
                for _ in range(3):
                    self.leaf("td", True, self.words(1, 6, False))
                self.out.append("</tr></table>")
            elif r < 0.80:
                self.leaf("div", True, self.words(10, 80))
            elif r < 0.82:
                self.open(self.pick(("section",)), True)
                self.leaf("h2", True, self.words(1, 6, False))
                self.leaf("p", True, self.words(10, 60))
                self.out.append("</section>")
            else:
                self.boilerplate()

    def hashed(self) -> str:
        """No name at all, or one that says nothing."""
        return "" if self.rng.random() < 0.4 else f' class="{self.pick("xcqvz")}{int(self.rng.integers(1, 99))}{self.pick("fghkw")}"'

    def anonymous(self) -> None:
        """A page of divs, or of table cells, whose names say nothing: only the text tells the article from the rest."""
        table = self.rng.random() < 0.35
        box, cell = ("tr", "td") if table else ("div", "div")

        def open_(element: str, content: bool) -> None:
            self.out.append(f"<{element}{self.hashed()}>")
            self.labels.append(content)

        def links() -> None:
            open_(box, False)
            if table:
                open_(cell, False)
            for _ in range(int(self.rng.integers(2, 8))):
                open_("div" if self.rng.random() < 0.5 else "p", False)
                self.out.append(f'<a href="/">{self.words(1, 4, False)}</a></{"div" if self.out[-1].startswith("<div") else "p"}>')
            self.out.append(f"</{cell}>" * table + f"</{box}>")

        def note() -> None:
            open_(box, False)
            if table:
                open_(cell, False)
            self.out.append(self.words(2, 8, False) + f' <a href="/">{self.words(1, 3, False)}</a>')
            self.out.append(f"</{cell}>" * table + f"</{box}>")

        wrap = int(self.rng.integers(0, 3))
        for _ in range(wrap):
            open_("div", False)
        if table:
            open_("table", False)
        for _ in range(int(self.rng.integers(0, 3))):
            self.pick((links, note))()
        open_(box, True)
        if table:
            open_(cell, True)
        inner = self.rng.random() < 0.4
        if inner:
            open_("div", True)
        head = self.rng.random()
        if head < 0.6:
            element = self.pick(("h1", "h2", "div"))
            open_(element, True)
            self.out.append(f"{self.words(2, 10, False)}</{element}>")
        for _ in range(int(self.rng.integers(2, 10))):
            element = self.pick(("p", "p", "div"))
            open_(element, True)
            self.out.append(f"{self.words(*self.pick(((8, 30), (20, 120))))}</{element}>")
        self.out.append("</div>" * inner + f"</{cell}>" * table + f"</{box}>")
        for _ in range(int(self.rng.integers(0, 3))):
            self.pick((links, note))()
        self.out.append("</table>" * table + "</div>" * wrap)

    def page(self) -> tuple[Page, np.ndarray]:
        if self.rng.random() < 0.2:
            self.open("body", False)
            self.anonymous()
            return read_page("<html>" + "".join(self.out) + "</body></html>"), np.array(self.labels)
        bare = self.rng.random() < 0.12  # no element around the text but body or a nameless div
        body = bare and self.rng.random() < 0.5
        self.open("body", bool(body), self.pick(KINDS), 0.3)
        around = "form" if not body and self.rng.random() < 0.08 else ""  # a form or a named layout around the whole page
        around = around or ("div" if not body and self.rng.random() < 0.08 else "")
        if around:
            self.open(around, False, self.pick(("form", "side", "nav", "head")), 0.8)
        for _ in range(int(self.rng.integers(0 if bare else 1, 5))):
            self.boilerplate()
        wrap = 0 if bare else int(self.rng.integers(0, 3))
        for _ in range(wrap):
            self.open("div", False, self.pick(("content", None)))
        outer = "" if body else "div" if bare else self.pick(("article", "article", "main", "div", "section"))
        if outer:
            self.open(outer, True, None if bare else "content", 0.4 if outer in ("article", "main") else 1.0)
        inner = bool(outer) and not bare and self.rng.random() < 0.4
        if inner:
            self.open("div", True, self.pick(("content", "content", None)))
        self.article(bool(outer) and not bare)
        self.out.append("</div>" * inner + f"</{outer}>" * bool(outer) + "</div>" * wrap)
        for _ in range(int(self.rng.integers(0 if bare else 1, 5))):
            self.boilerplate()
        self.out.append(f"</{around}>" * bool(around))
        page = read_page("<html>" + "".join(self.out) + "</body></html>")
        return page, np.array(self.labels)


def labelled_pages(n: int, seed: int = 0) -> tuple[list[Page], list[np.ndarray]]:
    made = [Writer(seed + k).page() for k in range(n)]
    made = [(p, y) for p, y in made if len(p.nodes) == len(y)]
    return [p for p, _ in made], [y for _, y in made]


@lru_cache(1)
def default_model() -> TreeModel:
    """Trained on 600 generated pages, the same at every run."""
    return train(*labelled_pages(600))


def dominant(page: Page) -> set[int]:
    """Nodes below the one whose own and children's text is more than half of the page's, links left out; else none.

    For pages on which no node is likely content: a layout that the model has not seen, or a very short article.
    Elements and names of navigation, forms and the like, at any height, take no part.
    """
    plain = [n.chars - n.linked for n in page.nodes]
    barred: list[bool] = []
    for n, large in zip(page.nodes, wide(page)):
        own = not large and (AT.get(n.element) in ASIDES or any(AT[KINDS[k]] in NOT_CONTENT for k in n.names))
        barred.append(own or (n.parent >= 0 and barred[n.parent]))
    near = [0] * len(plain)
    for k, n in enumerate(page.nodes):
        if not barred[k]:
            near[k] += plain[k]
            if n.parent >= 0:
                near[n.parent] += plain[k]
    best = max(range(len(near)), key=near.__getitem__)
    if 2 * near[best] <= sum(plain):
        return set()
    inside = {best}
    for k in range(best + 1, len(page.nodes)):
        if page.nodes[k].parent in inside and not barred[k]:
            inside.add(k)
    return inside


def main_texts(htmls: list[str | None], model: TreeModel) -> list[str]:
    """The main text of each page; a page without content has an empty one."""
    pages = [read_page(h) for h in htmls]
    if not pages:
        return []
    content, _ = model.marginals(*features(pages))
    out, base = [], 0
    for page in pages:
        texts = [text for node, text in page.blocks if content[base + node] >= 0.5]
        if not texts and page.blocks:
            inside = dominant(page)
            texts = [text for node, text in page.blocks if node in inside]
            if not any(c.isalnum() for text in texts for c in text):  # what is left of cut-off markup
                texts = []
        out.append("\n\n".join(texts))
        base += len(page.nodes)
    return out


def extract(pages: DataFrame, key: str = "page_id", model: TreeModel | None = None) -> DataFrame:
    """key, url, text and n_chars of every row of pages (key, url, html).

    A null html, or one without content, has an empty text. A page of any length is read whole, by itself if it is
    long, so a task holds one page or a few short ones. Markup that is cut off or badly nested is read as far as it
    goes. A node as likely content as not (a tie) is content. Rows that repeat come out each; other columns are
    dropped, whatever their names; an empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())
    kind = pages.schema[key].dataType.simpleString()

    def run(parts):
        for part in parts:
            texts = []
            for _, some in groups(part.column(2), 200_000):
                texts += main_texts(some, shared.value)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    return pages.select(F.col(key).alias("key"), "url", "html").mapInArrow(run, f"key {kind}, url string, text string, n_chars long").withColumnRenamed("key", key)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_extract": op2_html_extract}
ORACLES: dict[str, str] = {}
