"""Main-text extraction with a tree-structured graphical model.

A page is parsed to a tree of its block elements, with the text blocks as
leaves.  Every node is content or not.  A node's potential is a weighted sum of
its own tag, names and text; a parent-child potential has a cost for content below
something else and one for something else below content, both for elements and for text blocks.
All weights are fitted together by pseudo-likelihood: each node's label given its
neighbours'.  Sum-product messages upward and downward give exact marginals on the
tree, and the blocks whose content marginal is over one half are the text.

Training uses a bounded sample of pages that label themselves: in a page with one
``article`` or ``main`` landmark, blocks inside it (and in no landmark of another kind or
element named like one) are content, the rest is not.  Every such page is also taken
with the landmark read as a plain division, so text and layout carry weight, too.
Weights are drawn to stated prior means, which are what holds for names
the sample does not show.

Defined cases: null or empty html has no text; character references are decoded, white space in a
block is one space, ``br`` is white space, blocks are joined by a line feed;
unclosed and stray tags are mended as browsers do for paragraphs, items and cells; a hidden element left
open ends with the block around it, an unfinished script hides what follows it; with no page to learn from the prior weights and lifts stand;
repeated rows are extracted each.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

# fixed values: element kinds of HTML
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style template noscript head title iframe object svg math canvas audio video "
                    "select textarea button datalist".split())
_FOREIGN = frozenset("svg math".split())
#: Elements whose contents end no paragraph outside them.
_KEEPS_P = frozenset("td th table caption".split())
_BLOCK = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr "
                   "td th caption blockquote pre figure figcaption nav aside header footer form fieldset address "
                   "details summary dialog menu center hgroup search".split())
_KINDS = {
    "landmark": frozenset("article main".split()),
    "heading": frozenset("h1 h2 h3 h4 h5 h6 hgroup".split()),
    "prose": frozenset("p blockquote pre figure figcaption".split()),
    "list": frozenset("ul ol li dl dt dd".split()),
    "table": frozenset("table thead tbody tfoot tr td th caption".split()),
    "aside": frozenset("nav aside footer header form fieldset menu dialog search".split()),
}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
_OTHER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|footer|header|masthead|sidebar|side|aside|ads?|advert\w*|sponsor\w*|promo\w*|"
    r"banner|cookies?|consent|notice|alert|popup|modal|overlay|subscribe|newsletter|signup|login|search|share|social|"
    r"related|recommend\w*|comments?|commentlist|disqus|replies|reply|respond|breadcrumbs?|pagination|pager|widget|toolbar|"
    r"copyright|legal|skip|tags|complementary|contentinfo|form)(?:$|[\s_-]|\d)", re.IGNORECASE)
_MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text|prose)(?:$|[\s_-])", re.IGNORECASE)
_MARKS = re.compile(r"[.,;:!?]")

FEATURES = ("bias", "landmark", "heading", "prose", "list", "table", "aside", "other_name", "main_name", "leaf", "length",
            "links", "marks", "words", "place", "within")
#: Costs along an edge: content below other, other below content; for elements, then for text blocks.
EDGES = ("element_in_other", "element_in_content", "text_in_other", "text_in_content")
#: Prior means of the weights, in the order of FEATURES, then EDGES.
PRIOR = np.array([-0.5, 30.0, 0.5, 1.0, 0.0, 0.0, -200.0, -200.0, 8.0, 1.0, 1.0, -4.0, 1.0, 0.5, 0.0, 5.0, 5.0, 3.0, 6.0, 6.0])
#: How strongly they are held: as much as so many undecided nodes; edges more, as few pages show every pair.
HOLD = np.array([500.0] * len(FEATURES) + [5000.0] * len(EDGES))
#: Page-wide elements, whose names describe the page and not themselves.
_WIDE = frozenset("html body main".split())


class Tree(HTMLParser):
    """Block elements and text blocks of a page, as parallel lists in page order (parents first)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.kind, self.other, self.main, self.text, self.linked = [-1], [""], [False], [True], [None], [0]
        #: Open blocks: tag, node, and the place of the paragraph that a block element would end (-1: none).
        self.stack: list[tuple[str, int, int]] = [("", 0, -1)]
        self.open: Counter[str] = Counter()
        self.hidden: list[str] = []
        self.unseen: Counter[str] = Counter()                  # blocks opened inside what is hidden
        self.links = 0
        self.buffer: list[str] = []
        self.in_links = 0
        self.feed(html)
        self.close()
        self._flush()

    def _node(self, kind, other=False, main=False, text=None, linked=0):
        self.parent.append(self.stack[-1][1])
        self.kind.append(kind), self.other.append(other), self.main.append(main)
        self.text.append(text), self.linked.append(linked)
        return len(self.parent) - 1

    def _flush(self):
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                self._node("leaf", text=text, linked=min(self.in_links, len(text)))
            self.buffer, self.in_links = [], 0

    def _close(self, at: int):
        self._flush()
        self.open.subtract(tag for tag, _, _ in self.stack[at:])
        del self.stack[at:]

    def _push(self, tag: str, node: int):
        paragraph = len(self.stack) if tag == "p" else -1 if tag in _KEEPS_P else self.stack[-1][2]
        self.stack.append((tag, node, paragraph))
        self.open[tag] += 1

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            if tag == "body" and "head" in self.hidden:       # a head that was never closed
                self.hidden = []
            elif tag in _VOID:
                return
            else:
                if tag in _HIDDEN:
                    self.hidden.append(tag)
                elif tag in _BLOCK:
                    self.unseen[tag] += 1
                return
        if tag in _HIDDEN:
            self.hidden.append(tag)
            self.unseen.clear()
            return
        if tag in _BLOCK:
            if self.stack[-1][2] >= 0:
                self._close(self.stack[-1][2])
            if tag in _CLOSES and any(self.open[t] for t in _CLOSES[tag]):
                for i in range(len(self.stack) - 1, 0, -1):
                    if self.stack[i][0] in _CLOSES[tag]:
                        self._close(i)
                        if tag != "tr":
                            break
                    elif self.stack[i][0] in _SCOPE[tag]:
                        break
            self._flush()
            names = "" if tag in _WIDE else " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
            kind = next((k for k, tags in _KINDS.items() if tag in tags), "")
            node = self._node(kind, bool(names and _OTHER_NAMES.search(names)), tag in _WIDE or bool(names and _MAIN_NAMES.search(names)))
            self._push(tag, node)
        elif tag == "a":
            self.links += 1
        elif tag in ("br", "hr", "img"):
            self.buffer.append(" ")

    def handle_startendtag(self, tag, attrs):
        if tag not in _FOREIGN:                                # elsewhere a slash closes nothing in HTML
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag):]
                return
            if self.unseen[tag] > 0 or tag not in _BLOCK or not self.open[tag]:
                self.unseen[tag] -= self.unseen[tag] > 0
                return
            self.hidden = []                                   # the block around it ends, and so what was left open in it
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in _BLOCK and self.open[tag]:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] == tag:
                    self._close(i)
                    return

    def handle_data(self, data):
        if not self.hidden and data:
            self.buffer.append(data)
            if self.links:
                self.in_links += len(data)

    def unknown_decl(self, data):
        pass


def features(tree: Tree, plain_landmarks: bool = False) -> np.ndarray:
    """One row of FEATURES per node; an element's text is that of all blocks below it."""
    n = len(tree.parent)
    length, linked, marks = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n - 1, -1, -1):
        t = tree.text[i]
        if t is not None:
            length[i], linked[i], marks[i] = len(t), tree.linked[i], len(_MARKS.findall(t))
        p = tree.parent[i]
        if p >= 0:
            length[p] += length[i]
            linked[p] += linked[i]
            marks[p] += marks[i]
    x = np.zeros((n, len(FEATURES)))
    x[:, 0] = 1
    for i, kind in enumerate(tree.kind):
        if kind == "landmark" and plain_landmarks:
            continue
        if kind in _COLUMN:
            x[i, _COLUMN[kind]] = 1
    x[:, 7], x[:, 8] = tree.other, tree.main
    some = np.maximum(length, 1)
    x[:, 10] = np.log1p(length) / 4 - 1
    x[:, 11] = linked / some
    x[:, 12] = np.minimum(marks / some * 20, 1)
    x[:, 13] = np.log1p(length / 6) / 4
    x[:, 14] = np.abs(np.arange(n) / n - 0.5)
    if not plain_landmarks:
        for i in range(1, n):
            p = tree.parent[i]
            x[i, 15] = (x[p, 15] or tree.kind[p] == "landmark") and tree.kind[p] != "aside" and not tree.other[p]
    return x


_COLUMN = {k: FEATURES.index(k) for k in (*_KINDS, "leaf")}


def landmark_labels(tree: Tree) -> np.ndarray | None:
    """Labels of a page with one outermost landmark: what is below it and below nothing of another kind; else None.

    What the landmark is in counts as content, too: it holds content among other things.
    """
    marks = [i for i, k in enumerate(tree.kind) if k == "landmark"]
    n = len(tree.parent)
    if not marks:
        return None
    inside = np.zeros(n, bool)
    at = marks[0]
    while at >= 0:
        inside[at] = True
        at = tree.parent[at]
    within = np.zeros(n, bool)
    within[marks[0]] = True
    for i in range(marks[0] + 1, n):
        within[i] = within[tree.parent[i]]
    if not within[marks].all():
        return None
    for i in range(marks[0] + 1, n):
        inside[i] = within[i] and inside[tree.parent[i]] and tree.kind[i] != "aside" and not tree.other[i]
    return inside


@dataclass
class Model:
    """Node weights, and the EDGES costs."""

    weights: np.ndarray
    costs: np.ndarray

    def marginals(self, tree: Tree, x: np.ndarray) -> np.ndarray:
        """Content log-odds of every node: messages up to the root, then down.

        With two labels a message is one number, its log-odds.
        """
        parent, (e0, e1, t0, t1) = tree.parent, self.costs.tolist()
        below = [(t0, t1) if k == "leaf" else (e0, e1) for k in tree.kind]
        belief = (x @ self.weights).tolist()
        up = [0.0] * len(belief)
        for i in range(len(belief) - 1, 0, -1):                # children come after their parents
            a, b = below[i]
            up[i] = _ratio(belief[i], 0.0, -b, -a, 0.0)
            belief[parent[i]] += up[i]
        for i in range(1, len(belief)):                        # the parent's belief without this child's message
            a, b = below[i]
            belief[i] += _ratio(belief[parent[i]] - up[i], 0.0, -a, -b, 0.0)
        return np.array(belief)

    def text(self, html: str) -> str:
        tree = Tree(html)
        if len(tree.parent) == 1:
            return ""
        content = self.marginals(tree, features(tree))
        return "\n".join(t for t, c in zip(tree.text, content) if t is not None and c > 0)


def _ratio(t: float, on_on: float, on_off: float, off_on: float, off_off: float) -> float:
    """Log of (e^(t + on_on) + e^on_off) / (e^(t + off_on) + e^off_off), for log-odds ``t`` of the sender."""
    t = min(max(t, -60.0), 60.0)
    return log((exp(t + on_on) + exp(on_off)) / (exp(t + off_on) + exp(off_off)))


def examples(html: str) -> tuple[list[list[float]], list[int]] | None:
    """Rows of FEATURES and EDGES (neighbours' labels) and labels of a page's nodes; None without one landmark."""
    tree = Tree(html)
    inside = landmark_labels(tree)
    if inside is None:
        return None
    near = np.zeros((len(inside), len(EDGES)))
    for i in range(1, len(inside)):
        p, k = tree.parent[i], 2 * (tree.kind[i] == "leaf")
        near[i, k] -= not inside[p]
        near[i, k + 1] += inside[p]
        near[p, k] += inside[i]
        near[p, k + 1] -= not inside[i]
    x = np.concatenate([np.hstack([features(tree, plain_landmarks=plain), near]) for plain in (False, True)])
    return x.tolist(), np.concatenate([inside, inside]).astype(int).tolist()


def fit(x: np.ndarray, y: np.ndarray, hold: np.ndarray = HOLD, steps: int = 30) -> Model:
    """Newton's method on the pseudo-likelihood, all weights drawn to PRIOR by HOLD."""
    w = PRIOR.copy()
    for _ in range(steps if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - hold * (w - PRIOR)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    k = len(FEATURES)
    return Model(w[:k], np.maximum(w[k:], 0.0))


def fit_pages(pages: DataFrame, html: str = "html", page_id: str = "page_id", sample: int = 400) -> Model:
    """Fit on the ``sample`` pages of smallest id hash (the bound); only their nodes' features reach the driver."""
    def learn(batches):
        for batch in batches:
            found = [e for e in map(examples, texts(batch.column("html"))) if e is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[0] for e in found], pa.list_(pa.list_(pa.float64()))),
                 pa.array([e[1] for e in found], pa.list_(pa.int32()))], ["x", "y"])

    chosen = (pages.select(F.xxhash64(page_id).alias("k"), F.col(html).cast("string").alias("html")).where("html is not null")
              .orderBy("k", F.xxhash64("html")).limit(sample).select("html"))
    rows = chosen.mapInArrow(learn, "x array<array<double>>, y array<int>").collect()
    if not rows:
        return fit(np.zeros((0, len(PRIOR))), np.zeros(0))
    return fit(np.concatenate([np.array(r["x"]) for r in rows]),
               np.concatenate([np.array(r["y"], dtype=float) for r in rows]))


def extract_text(pages: DataFrame, model: Model, html: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with each whole page's main text in column ``to``; row-local, no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    udf = F.arrow_udf(lambda h: pa.array([shared.value.text(x) for x in texts(h)], pa.string()), "string")
    return pages.withColumn(to, udf(F.col(html).cast("string")))
