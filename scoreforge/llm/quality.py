"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are whole-text counts and ratios.  Trees are grown level by level
on binned statistics (logistic loss) and flattened into arrays, so a batch of
documents walks all trees in a few numpy steps.

Defined cases: null text reads as empty; an empty text has zero statistics and
gets the score the trees give those; null or repeated labels: rows without a
0/1 quality are ignored, a document labelled twice counts once per label; no
usable label at all gives every document the prior score 0.9.  Extra columns
of the input are passed through untouched.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

FEATURES = (
    "log_chars", "log_words", "word_len", "distinct_words", "top_word", "distinct_pairs", "lines", "line_len",
    "distinct_lines", "lower", "upper", "digits", "space", "sentence_marks", "symbols", "non_ascii", "alpha_words",
    "upper_words", "title_words", "one_letter_words", "longest_word", "symbol_ended", "squeeze", "pipes",
)
_LOWER = bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_MARKS = b".,;:?!'\"()-"
_HIGH = bytes(range(128, 256))
_SYMBOL_END = re.compile(r"[^\w\s.,;:?!'\")\]]\Z")


def statistics(text: str) -> list[float]:
    """The FEATURES of one whole text."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    n, w = len(raw), len(words)
    rest = n
    shares = []
    for group in (_LOWER, _UPPER, _DIGITS, _SPACE, _MARKS, _HIGH):
        left = len(raw.translate(None, group))
        shares.append((n - left) / n)
        rest -= n - left
    lower, upper, digits, space, marks, high = shares
    counts = Counter(words)
    lines = text.split("\n")
    lengths = list(map(len, counts))
    ended = sum(c for x, c in counts.items() if _SYMBOL_END.search(x))
    return [
        np.log1p(n), np.log1p(w), len(text) / w, len(counts) / w, max(counts.values()) / w,
        (len(set(zip(words, words[1:]))) + 1) / w, np.log1p(len(lines)), np.log1p(n / len(lines)),
        len(set(lines)) / len(lines), lower, upper, digits, space, marks, rest / n, high,
        sum(c for x, c in counts.items() if x.isalpha()) / w,
        sum(c for x, c in counts.items() if x.isupper()) / w,
        sum(c for x, c in counts.items() if x.istitle()) / w,
        sum(c for x, c in counts.items() if len(x) == 1) / w,
        np.log1p(max(lengths)), ended / w, len(zlib.compress(raw, 1)) / n, counts.get("|", 0) / w,
    ]


def statistics_matrix(values: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in values], dtype=np.float64).reshape(len(values), len(FEATURES))


@dataclass
class Forest:
    """Trees as flat arrays; node i's children are ``left[i]`` and ``left[i] + 1``."""

    base: float
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    depth: int = 0

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row: every (row, tree) pair steps down together, a leaf points to itself."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            leaf = self.left[at] < 0
            down = self.left[at] + (x[rows, self.feature[at]] > self.threshold[at])
            at = np.where(leaf, at, down)
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(x)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2,
               ridge: float = 1.0, least: int = 10) -> Forest:
    """Histogram boosting on logistic loss; one label only gives the smoothed prior."""
    n = len(y)
    prior = (y.sum() + 9.0) / (n + 10.0)
    forest = Forest(base=float(np.log(prior / (1 - prior))))
    if n == 0 or y.min() == y.max():
        return forest
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    column = np.arange(d) * bins
    feature, threshold, left, value, roots = [], [], [], [], []
    raw = np.full(n, forest.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        roots.append(len(feature))
        at = np.full(n, len(feature))          # node of each row
        level = [len(feature)]
        feature.append(0), threshold.append(0.0), left.append(-1), value.append(0.0)
        for step in range(depth + 1):
            slot = {node: k for k, node in enumerate(level)}
            where = np.array([slot.get(v, -1) for v in range(level[0], level[-1] + 1)])
            inside = (at >= level[0]) & (at <= level[-1])
            k = where[at[inside] - level[0]]
            key = (k[:, None] * (d * bins) + column + binned[inside]).ravel()
            size = len(level) * d * bins
            shape = (len(level), d, bins)
            gs = np.bincount(key, np.repeat(g[inside], d), size).reshape(shape)
            hs = np.bincount(key, np.repeat(h[inside], d), size).reshape(shape)
            cs = np.bincount(key, minlength=size).reshape(shape)
            total_g, total_h, total_c = gs[:, 0].sum(1), hs[:, 0].sum(1), cs[:, 0].sum(1)
            for node, i in slot.items():
                value[node] = rate * total_g[i] / (total_h[i] + ridge)
            if step == depth:
                break
            lg, lh, lc = gs.cumsum(2), hs.cumsum(2), cs.cumsum(2)
            rg, rh, rc = (t[:, None, None] - c for t, c in ((total_g, lg), (total_h, lh), (total_c, lc)))
            gain = lg ** 2 / (lh + ridge) + rg ** 2 / (rh + ridge) - (total_g ** 2 / (total_h + ridge))[:, None, None]
            gain[(lc < least) | (rc < least)] = -1
            best = gain.reshape(len(level), -1).argmax(1)
            following = []
            for node, i in slot.items():
                j, b = divmod(int(best[i]), bins)
                if gain[i, j, b] <= 1e-6 or b >= len(edges[j]):
                    continue
                feature[node], threshold[node], left[node] = j, float(edges[j][b]), len(feature)
                mine = at == node
                at[mine] = len(feature) + (binned[mine, j] > b)
                for _side in (0, 1):
                    following.append(len(feature))
                    feature.append(0), threshold.append(0.0), left.append(-1), value.append(0.0)
            if not following:
                break
            level = following
        raw += np.array(value)[at]
    forest.feature, forest.left = np.array(feature, np.int32), np.array(left, np.int32)
    forest.threshold, forest.value = np.array(threshold), np.array(value)
    forest.roots, forest.depth = np.array(roots, np.int32), depth
    return forest


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id's text falls in the held-out fold; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
                label: str = "quality", sample: int = 20_000, **params) -> Forest:
    """Fit on at most ``sample`` labelled rows (the bound), the ones of smallest id hash.

    Rows of the held-out fold are never used.  The sampled ids and labels, and
    then their statistics, are what reaches the driver; both are bounded by ``sample``
    labels (times the copies of a repeated id).
    """
    usable = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where(
        F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    stats = F.arrow_udf(lambda t: pa.array(statistics_matrix(texts(t)).tolist(), pa.list_(pa.float64())),
                        "array<double>")
    rows = (docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
            .join(F.broadcast(chosen), "_id")
            .select("_y", "_id", F.xxhash64("_text").alias("_t"), stats("_text").alias("_x"))
            .orderBy(F.xxhash64("_id"), "_id", "_t").limit(sample).select("_y", "_x").collect())
    x = np.array([r["_x"] for r in rows]).reshape(len(rows), len(FEATURES))
    return fit_forest(x, np.array([r["_y"] for r in rows], dtype=np.float64), **params)


def score_quality(docs: DataFrame, forest: Forest, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the forest's score of every whole text in column ``to``."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def score(column):
        values = texts(column)
        out = [shared.value.score(statistics_matrix(values[i:i + 1024])) for i in range(0, len(values), 1024)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return docs.withColumn(to, F.arrow_udf(score, "double")(F.col(text).cast("string")))
