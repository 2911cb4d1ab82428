"""Periodic runs of words: suffix trees of a text and its reversal, constant-time extensions, Lyndon roots.

A run is a stretch of consecutive words with smallest period q and at least two periods (and
``least`` words) that no neighbouring word extends.  By the runs theorem every run has a root
that is the longest Lyndon word starting at some place, in one of two opposite orders of
the alphabet; that word ends before the next smaller (or next greater) suffix.  So each place gives two candidates,
and each candidate is extended to the right and to the left: the length of a common
extension is the string depth of the lowest common ancestor of two leaves, which the Euler tour of
a suffix tree answers in constant time.  Ukkonen's algorithm builds the trees.

Trees are built only of the words that can lie in a run.  A run of L >= max(12, 2q) words has
L - q >= 6 equal words at distance q, hence its words are all covered by stretches of ``least // 2`` words that
occur twice in the text (equal hashes are taken for equal here, which can only keep more).  Any two
such neighbouring stretches touch, so every run lies whole in one covered piece, and the pieces, with a separator of
its own after each, make up the text the trees are built of.

Defined cases: null text reads as empty, no words, no runs; repeated rows and copies are treated alike; a word
is what stands between ASCII white space; whole texts are read, memory grows with one text's covered words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Odd multipliers that mix the places of a stretch's words.
_MIX = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 65)], np.uint64)
_BLOCK = 16


class SuffixTree:
    """Ukkonen's suffix tree of symbols ``s`` (the last one occurs once), with its Euler tour.

    ``tour`` holds the string depth of each node the tour stands on, ``first`` the place of each
    suffix's leaf in it; ``ranks`` are the suffixes' places in lexicographic order.
    """

    def __init__(self, s: list[int]):
        self._walk(s, *self._build(s))

    @staticmethod
    def _build(s: list[int]) -> tuple[list, list, list]:
        n = len(s)
        start, stop, link, sons = [0], [0], [0], [{}]     # the root; leaves have no sons
        suffix = [-1]                                     # of a leaf
        node = at = length = made = 0                     # the active point; suffixes whose leaf exists
        for i, c in enumerate(s):
            last = 0
            while made <= i:
                if not length:
                    at = i
                branch = sons[node]
                head = s[at]
                son = branch.get(head)
                if son is None:
                    branch[head] = len(start)
                    if last:
                        link[last] = node
                    last = 0
                else:
                    begin = start[son]
                    size = min(stop[son], i + 1) - begin
                    if length >= size:
                        at += size
                        length -= size
                        node = son
                        continue
                    middle = s[begin + length]
                    if middle == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    inner = branch[head] = len(start)
                    start.append(begin)
                    stop.append(begin + length)
                    link.append(0)
                    suffix.append(-1)
                    start[son] = begin + length
                    sons.append({middle: son, c: inner + 1})
                    if last:
                        link[last] = inner
                    last = inner
                start.append(i)
                stop.append(n)
                link.append(0)
                suffix.append(made)
                sons.append(None)
                made += 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = made
        return [b - a for a, b in zip(start, stop)], suffix, sons

    def _walk(self, s: list[int], sizes: list, suffix: list, sons: list):
        tour, order = [], []
        first = [0] * len(s)
        path = [(0, iter(sorted(sons[0].items())))]
        tour.append(0)
        while path:
            depth, rest = path[-1]
            for _, son in rest:
                below = depth + sizes[son]
                if sons[son] is None:
                    leaf = suffix[son]
                    first[leaf] = len(tour)
                    order.append(leaf)
                    tour += (below, depth)
                else:
                    tour.append(below)
                    path.append((below, iter(sorted(sons[son].items()))))
                    break
            else:
                path.pop()
                if path:
                    tour.append(path[-1][0])
        self.first = np.array(first, np.int64)
        self.ranks = np.empty(len(s), np.int64)
        self.ranks[order] = np.arange(len(s))
        self._minima(np.array(tour, np.int64))

    def _minima(self, tour: np.ndarray):
        """Tables that answer the least value of any stretch of the tour, linear in its length."""
        blocks = -(-len(tour) // _BLOCK)
        grid = np.full((blocks, _BLOCK), np.iinfo(np.int64).max)
        grid.ravel()[:len(tour)] = tour
        self.grid = grid
        self.ahead = np.minimum.accumulate(grid, axis=1).ravel()
        self.behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.sparse = [grid.min(axis=1)]
        while 2 << (len(self.sparse) - 1) <= blocks:
            half = 1 << (len(self.sparse) - 1)
            self.sparse.append(np.minimum(self.sparse[-1][:-half], self.sparse[-1][half:]))

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the different suffixes i and j, pairwise."""
        a, b = self.first[i], self.first[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        x, y = a // _BLOCK, b // _BLOCK
        out = np.minimum(self.behind[a], self.ahead[b])
        own = np.flatnonzero(x == y)
        columns = np.arange(_BLOCK)
        for part in np.array_split(own, len(own) // 65536 + 1):
            inside = (columns >= (a[part] % _BLOCK)[:, None]) & (columns <= (b[part] % _BLOCK)[:, None])
            out[part] = np.where(inside, self.grid[x[part]], np.iinfo(np.int64).max).min(axis=1)
        wide = np.flatnonzero(y - x > 1)
        level = np.frexp((y - x - 1)[wide].astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = wide[level == k]
            table = self.sparse[k]
            out[at] = np.minimum(out[at], np.minimum(table[x[at] + 1], table[y[at] - (1 << int(k))]))
        return out


def next_smaller(values: list[int]) -> list[int]:
    """Place of the next smaller value after each place; the length where there is none."""
    out, open_ = [len(values)] * len(values), []
    for j, v in enumerate(values):
        while open_ and values[open_[-1]] > v:
            out[open_.pop()] = j
        open_.append(j)
    return out


def all_runs(s: list[int]) -> np.ndarray:
    """(start, stop, period) of every maximal repetition of two periods or more; the last symbol occurs once."""
    n = len(s) - 1
    tree = SuffixTree(s)
    ranks = tree.ranks.tolist()
    # the last symbol ends no prefix of another suffix, so the opposite order of suffixes is the reversed one
    ends = np.array([next_smaller(ranks), next_smaller([-r for r in ranks])])
    i, j = np.tile(np.arange(n + 1), 2), ends.ravel()
    i, j = i[j <= n], j[j <= n]
    right = tree.extension(i, j)
    del tree
    left = SuffixTree(s[n - 1::-1] + s[n:] if n else s).extension(n - i, n - j) if n else right
    start, stop, period = i - left, j + right, j - i
    good = stop - start >= 2 * period
    found = np.stack([start[good], stop[good], period[good]], axis=1)
    return np.unique(found, axis=0)


def covered(marks: np.ndarray, width: int) -> np.ndarray:
    """Whether each word lies in a stretch of ``width`` words that occurs twice."""
    n = len(marks)
    cover = np.zeros(n + 1, np.int64)
    if n <= width:
        return cover[:n] > 0
    grams = marks[:n - width + 1] * _MIX[0]
    for k in range(1, width):
        grams = grams + (marks[k:n - width + 1 + k] ^ marks[k:n - width + 1 + k] >> np.uint64(29)) * _MIX[k]
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    twice = ranked[1:] == ranked[:-1]
    if not twice.any():
        return cover[:n] > 0
    again = np.zeros(len(grams), bool)
    again[order[1:][twice]] = True
    again[order[:-1][twice]] = True
    cover[:len(grams)] += again
    cover[width:] -= again
    return np.cumsum(cover)[:n] > 0


def runs_of(words: list[bytes], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's words with ``least`` words or more, by start, then period."""
    n = len(words)
    if n < least:
        return []
    width = least // 2
    if not 1 <= width <= len(_MIX):
        raise ValueError(f"least must lie between 2 and {2 * len(_MIX) + 1}")
    within = covered(np.fromiter(map(hash, words), np.int64, n).view(np.uint64), width)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], within, [False]])))
    pieces = [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= least]
    if not pieces:
        return []
    numbers: dict[bytes, int] = {}
    symbols, places = [], []
    for k, (a, b) in enumerate(pieces):
        symbols += [numbers.setdefault(w, len(numbers)) for w in words[a:b]]
        symbols.append(-1 - k)                            # a separator of its own ends each piece
        places.append(np.arange(a, b + 1))
    found = all_runs(symbols)
    found = found[found[:, 1] - found[:, 0] >= least]
    start = np.concatenate(places)[found[:, 0]]
    out = np.stack([start, found[:, 1] - found[:, 0], found[:, 2]], axis=1)
    return [tuple(r) for r in out[np.lexsort((out[:, 2], out[:, 0]))].tolist()]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds beyond its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()
    return b" ".join([words[i] for i in kept])


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_FOUND = pa.struct([("words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())])
FOUND = "struct<words: long, runs: array<struct<start: long, length: long, period: long>>, collapsed: string>"


def _scan(column: pa.Array, least: int) -> pa.Array:
    sizes, found, texts = [], [], []
    for raw in _bytes(column):
        words = raw.split()                               # of bytes: at ASCII white space only
        runs = runs_of(words, least)
        sizes.append(len(words))
        found.append([{"start": a, "length": n, "period": q} for a, n, q in runs])
        texts.append(collapsed(words, runs))
    return pa.StructArray.from_arrays(
        [pa.array(sizes, pa.int64()), pa.array(found, _RUNS), pa.array(texts, pa.binary()).view(pa.string())],
        fields=list(_FOUND))


def periodic_runs(docs: DataFrame, text: str = "text", to: str = "periodic", least: int = 12) -> DataFrame:
    """``docs`` with a struct of the word count, every run and the collapsed text; row-local, no shuffle."""
    udf = F.arrow_udf(lambda column: _scan(column, least), FOUND)
    return docs.withColumn(to, udf(F.col(text).cast("string")))


def _repeat(text: pa.Array, h: pa.Array) -> pa.Array:
    out = []
    for raw, k in zip(text.cast(pa.binary()).to_pylist(), h.to_pylist()):
        words = [] if raw is None else raw.split()
        if words:
            n, g = len(words), k // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            raw = b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)])
        out.append(raw)
    return pa.array(out, pa.binary()).view(pa.string())


def repeated_tails(text: Column, doc_id: Column) -> Column:
    """Texts of which every tenth (by the crc32 of its id) ends in repetitions of one of its stretches; a null id in none."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    chosen = F.when(h % 10 == 0, text.cast("string"))
    return F.coalesce(F.arrow_udf(_repeat, "string")(chosen, h), text.cast("string"))


def run_report(found: DataFrame, doc_id: str = "doc_id", name: str = "periodic") -> DataFrame:
    """Per document: count, the longest run (ties: smallest start, then period) and digests of ``periodic_runs``."""
    runs = F.col(f"{name}.runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"),
                                                            (-r["period"]).alias("shorter"))))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        F.col(doc_id).alias("doc_id"), F.size(runs).cast("long").alias("n_runs"), best.alias("_best"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col(f"{name}.collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).selectExpr("doc_id", "n_runs", "-_best.before AS start", "_best.length AS length", "-_best.shorter AS period",
                 "1000 * _best.length div -_best.shorter AS exponent_milli", "runs_sha256", "collapsed_sha256")
