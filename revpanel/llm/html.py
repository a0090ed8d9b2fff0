"""Main text of web pages by a tree-structured graphical model.

Each node of the DOM carries a hidden label: main text or not. Emission potentials score the node's own features,
potentials between parent and child tie their labels, and both are counted on labelled pages. Sum-product messages go
upward and then downward, which gives each node's exact marginal; texts with a marginal over one half are kept.
All pages of a batch are one forest, whose messages are computed level by level with numpy.
"""

from __future__ import annotations

import functools
import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revpanel.llm.common import mapped
from revpanel.llm.pages import labelled_pages

#: The beginnings of comments, declarations and tags. None looks further than its own name.
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
_REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_QUOTES = re.compile("[\"'>]")
_NAMED = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_LABEL = re.compile(r'data-y="(\d)"')
_PARTS = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html iframe legend li main menu nav noscript ol option p pre script section select style summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: A start tag on the left ends an open element on the right, unless one of _STOPS is open inside.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tfoot"}, "thead": {"thead", "tbody", "tfoot"}, "tfoot": {"thead", "tbody", "tfoot"},
}
_STOPS = frozenset("article aside body div dl fieldset footer form header html main nav ol section table ul blockquote".split())
_NO_P = BLOCK - {"body", "button", "caption", "dialog", "head", "html", "iframe", "noscript", "option", "script", "select", "style", "tbody", "td", "textarea", "tfoot", "th", "thead", "title", "tr"}
AGAINST = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo nav navbar navigation menu topnav breadcrumb breadcrumbs sidebar footer header comment comments "
    "reply replies discussion responses disqus cookie cookies consent notice popup modal overlay share social related recommended subscribe newsletter login signup "
    "form widget toolbar legal copyright hidden pagination pager tags".split()
)
IN_FAVOUR = frozenset("article content post entry story body main text prose".split())
TAGS = ("#text", *sorted(BLOCK | VOID | {"a", "b", "em", "i", "span", "strong", "u", "small", "code", "label", "svg", "sup", "sub", "time"}), "#other")
_TAG = {t: i for i, t in enumerate(TAGS)}
FEATURES = (len(TAGS), 4, 5, 6)


class _TagEnds:
    """Where a tag ends that begins at some place: the next > outside quotes, or, if there is none, the next >.

    A quote that never closes would make every tag after it look through the rest of the page. From the first such one on, the
    ends are looked up in a table, made once from the end of the page backwards.
    """

    def __init__(self, source: str):
        self.source, self.last, self.at = source, source.rfind(">"), None

    def __call__(self, place: int) -> int:
        """The end of the tag, behind its >; -1 if there is no > at all."""
        if place > self.last:
            return -1
        if self.at is None:
            if m := _REST.match(self.source, place):
                return m.end()
            marks = [(m.start(), m[0]) for m in _QUOTES.finditer(self.source, place)]
            # The end as seen outside quotes, within double and within single ones.
            outside = double = single = -1
            self.at, self.end = [p for p, _ in marks], [0] * (len(marks) + 1)
            self.end[-1] = -1
            for i in range(len(marks) - 1, -1, -1):
                p, c = marks[i]
                if c == ">":
                    outside = p + 1
                elif c == '"':
                    outside, double = double, outside
                else:
                    outside, single = single, outside
                self.end[i] = outside
        end = self.end[bisect_left(self.at, place)]
        return end if end >= 0 else self.source.find(">", place) + 1


def _tags(source: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, name, whether an end tag, attributes) of each tag; comments and declarations without a name.

    A < that begins nothing, or a tag without any > after it, is text. The content of raw elements is passed over.
    """
    at, ends = 0, _TagEnds(source)
    while (at := source.find("<", at)) >= 0:
        if at > ends.last:
            # No tag ends any more; a comment may still begin.
            at = source.find("<!--", at)
            if at >= 0:
                yield at, len(source), None, False, ""
            return
        m = _OPEN.match(source, at)
        if m is None:
            at += 1
            continue
        if m[1]:
            end = source.find("-->", m.end())
            end = end + 3 if end >= 0 else len(source)
            yield at, end, None, False, ""
        elif m[2]:
            end = source.find(">", m.end()) + 1
            yield at, end, None, False, ""
        else:
            end, name = ends(m.end()), m[4].lower()
            yield at, end, name, bool(m[3]), source[m.end() : end - 1]
            if name in RAW and not m[3] and source[end - 2] != "/":
                end = _raw_end(source, name, end)
        at = end


@functools.lru_cache(maxsize=64)
def _end_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I)


def _raw_end(source: str, name: str, at: int) -> int:
    m = _end_tag(name).search(source, at)
    return m.start() if m else len(source)


class Forest:
    """Nodes of a batch of pages in document order."""

    def __init__(self):
        self.parent, self.depth, self.tag, self.cue, self.page, self.block = [], [], [], [], [], []
        self.text: dict[int, str] = {}
        self.label: list[int] = []
        self.blocks = self.pages = 0

    def _node(self, parent: int, tag: int, cue: int, label: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.cue.append(cue)
        self.page.append(self.pages)
        self.block.append(self.blocks)
        self.label.append(label)
        return len(self.parent) - 1

    def _text(self, stack: list, raw: str) -> None:
        if raw:
            n = self._node(stack[-1][1], 0, 0, self.label[stack[-1][1]])
            self.text[n] = entities.unescape(raw) if "&" in raw else raw

    def add(self, source: str | None) -> None:
        """Parse one page: forgiving of missing, crossed and unknown tags."""
        source = source or ""
        root = self._node(-1, _TAG["#other"], 0, 0)
        stack, at = [("#root", root)], 0
        # Where in the stack each element is open, and those that end the look for one, so that no tag costs a look through it.
        opened: dict[str, list[int]] = {}
        stops: list[int] = [0]

        def close(k: int) -> None:
            for i in range(len(stack) - 1, k - 1, -1):
                opened[stack[i][0]].pop()
                if stops[-1] == i:
                    stops.pop()
            del stack[k:]

        for start, end, name, closing, attrs in _tags(source):
            self._text(stack, source[at:start])
            at = end
            if name is None:
                continue
            if name in BLOCK:
                self.blocks += 1
            if closing:
                if opened.get(name):
                    close(opened[name][-1])
                continue
            ends = _ENDS.get(name, ())
            if name in _NO_P:
                ends = {*ends, "p"}
            while (k := max((opened[e][-1] for e in ends if opened.get(e)), default=0)) > stops[-1]:
                close(k)
            cue = 0
            if "=" in attrs:
                for value in _NAMED.findall(attrs):
                    parts = set(_PARTS.findall(value.lower()))
                    cue |= (not parts.isdisjoint(IN_FAVOUR)) | 2 * (not parts.isdisjoint(AGAINST))
            y = _LABEL.search(attrs) if "data-y" in attrs else None
            node = self._node(stack[-1][1], _TAG.get(name, len(TAGS) - 1), cue, int(y[1]) if y else 0)
            if name == "br":
                self._text([*stack, (name, node)], " ")
            if name in VOID or attrs.endswith("/"):
                continue
            opened.setdefault(name, []).append(len(stack))
            if name in _STOPS:
                stops.append(len(stack))
            stack.append((name, node))
            if name in RAW:
                end = _raw_end(source, name, at)
                self._text(stack, source[at:end])
                at = end
        self._text(stack, source[at:])
        self.pages += 1
        self.blocks += 1

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """int[n, len(FEATURES)] and the parents."""
        n, parent, depth = len(self.parent), np.array(self.parent), np.array(self.depth)
        tag, size, linked = np.array(self.tag), np.zeros(n), np.zeros(n)
        for i, t in self.text.items():
            size[i] = len(t.strip())
        a = tag == _TAG["a"]
        for d in range(int(depth.max(initial=0)), 0, -1):
            at = self._level(depth, d)
            linked[at] = np.where(a[at], size[at], linked[at])
            np.add.at(size, parent[at], size[at])
            np.add.at(linked, parent[at], linked[at])
        share = np.where(size > 0, linked / np.maximum(size, 1), -1)
        f = np.stack([tag, self.cue, np.digitize(share, [0, 0.05, 0.4, 0.8]), np.digitize(size, [1, 12, 40, 150, 600])], 1)
        return f, parent

    @functools.cached_property
    def _order(self) -> tuple[np.ndarray, np.ndarray]:
        depth = np.array(self.depth)
        order = np.argsort(depth, kind="stable")
        return order, np.searchsorted(depth[order], np.arange(int(depth.max(initial=0)) + 2))

    def _level(self, depth: np.ndarray, d: int) -> np.ndarray:
        order, starts = self._order
        return order[starts[d] : starts[d + 1]]


#: Elements that are part of a sentence: their label is nearly always that of their parent.
PHRASE = frozenset("a b em i span strong u small code sup sub time br wbr img".split())
_KIND = np.array([0, *[2 if t in PHRASE else 1 for t in TAGS[1:]]])


def edge_kinds(f: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Kind of the edge above each node: to a text, a block or a phrase; those below the body are kinds of their own."""
    kind = _KIND[f[:, 0]]
    return np.where(np.isin(f[parent, 0], [_TAG["body"], _TAG["html"]]), 3 + (kind == 1), kind)


class TreeModel:
    """Log potentials: root[2], pair[kind, parent, child], emission per feature [value, label]."""

    def __init__(self, root: np.ndarray, pair: np.ndarray, emission: list[np.ndarray]):
        self.root, self.pair, self.emission = root, pair, emission

    @classmethod
    def train(cls, pages: list[str]) -> TreeModel:
        """Counts on four fifths of the pages; the weights of the features, which depend on each other, fitted on the rest."""
        at = len(pages) * 4 // 5
        forest, rest = Forest(), Forest()
        for k, p in enumerate(pages):
            (forest if k < at else rest).add(p)
        f, parent = forest.features()
        y = np.array(forest.label)
        emission = []
        for j, size in enumerate(FEATURES):
            c = np.full((size, 2), 0.2)
            np.add.at(c, (f[:, j], y), 1)
            emission.append(np.log(c / c.sum(0)))
        child = np.flatnonzero(parent >= 0)
        c = np.full((5, 2, 2), 0.5)
        np.add.at(c, (edge_kinds(f, parent)[child], y[parent[child]], y[child]), 1)
        pair = np.log(c / c.sum(2, keepdims=True))
        truth, weights = np.array(rest.label), [1.0] * len(FEATURES)

        def model(w: list[float]) -> TreeModel:
            return cls(np.log([0.99, 0.01]), pair, [e * x for e, x in zip(emission, w)])

        def loss(w: list[float]) -> float:
            p = np.clip(model(w).marginals(rest), 1e-9, 1 - 1e-9)
            return -float(np.where(truth, np.log(p), np.log(1 - p)).mean())

        best = loss(weights) if rest.parent else 0.0
        for _ in range(2 if rest.parent else 0):
            for j in range(len(weights)):
                for x in (0.25, 0.5, 0.75, 1.0, 1.25, 1.5):
                    tried = [*weights[:j], x, *weights[j + 1 :]]
                    if (now := loss(tried)) < best - 1e-6:
                        best, weights = now, tried
        return model(weights)

    def marginals(self, forest: Forest) -> np.ndarray:
        """P(main text) of every node, by one pass of messages upward and one downward."""
        f, parent = forest.features()
        depth, kind = np.array(forest.depth), edge_kinds(f, parent)
        belief = sum(e[f[:, j]] for j, e in enumerate(self.emission))
        top = int(depth.max(initial=0))
        up = np.zeros_like(belief)
        for d in range(top, 0, -1):
            at = forest._level(depth, d)
            up[at] = np.logaddexp(*np.moveaxis(self.pair[kind[at]] + belief[at][:, None, :], 2, 0))
            np.add.at(belief, parent[at], up[at])
        belief[depth == 0] += self.root
        for d in range(1, top + 1):
            at = forest._level(depth, d)
            rest = belief[parent[at]] - up[at]
            rest -= rest.max(1, keepdims=True)
            belief[at] += np.logaddexp(*np.moveaxis(self.pair[kind[at]] + rest[:, :, None], 1, 0))
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))


@functools.lru_cache(maxsize=2)
def trained_model(pages: int = 500) -> TreeModel:
    """The model of ``pages`` generated labelled pages (a fixed number, whatever the input)."""
    return TreeModel.train(labelled_pages(pages))


def main_texts(model: TreeModel, pages: list[str | None]) -> list[str]:
    forest = Forest()
    for p in pages:
        forest.add(p)
    p = model.marginals(forest)
    out: list[list[list[str]]] = [[] for _ in pages]
    last = None
    for i, t in forest.text.items():
        if p[i] > 0.5:
            blocks = out[forest.page[i]]
            if last != forest.block[i]:
                blocks.append([])
                last = forest.block[i]
            blocks[-1].append(t)
    joined = ([" ".join("".join(b).split()) for b in blocks] for blocks in out)
    return ["\n".join(b for b in blocks if b) for blocks in joined]


#: Characters of html in one forest.
BATCH_CHARS = 4_000_000


def extract_main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns and text: the main text of every whole page, blocks joined by newlines.

    Null and empty pages have empty text, as have pages without main text; character references are decoded, white space
    within a block becomes one space. Rows that repeat are each returned; an empty table gives an empty result;
    columns not kept are not read.
    """
    model = pages.sparkSession.sparkContext.broadcast(trained_model())

    def texts_of(html: pa.Array) -> list:
        sources, at = html.to_pylist(), 0
        texts: list[str] = []
        while at < len(sources):
            end, size = at, 0
            while end < len(sources) and (end == at or size < BATCH_CHARS):
                size += len(sources[end] or "")
                end += 1
            texts += main_texts(model.value, sources[at:end])
            at = end
        return [texts]

    plain = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{html}`").alias("html"))
    found = mapped(plain, ["html"], "text string", lambda: texts_of)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text")
