"""Benchmark decontamination: pigeonhole edit matching with Myers verification.

Texts and items are compared on their lower-cased letters and digits, any run
of other characters read as one space.  An item of m such characters may be
matched with ``floor(rate * m)`` edits.  It is cut into one more piece than
that, so any passage within the budget holds at least one piece unchanged.
An Aho-Corasick automaton finds every exact piece hit in a text; each hit names
a window of the text, and Myers' bit-parallel distance of the whole item to
the best substring of the window decides.  All windows of a batch are advanced
together, one text character at a time, in 64-bit words.

The benchmark is the stated query set: it is taken in blocks of at most
``block_chars`` characters (the bound of what is broadcast), and each block is
held against all documents.

Defined cases: null or empty texts match nothing; null, empty or symbol-only
items are ignored; items with a null id match like others; an item repeated
under several ids is reported under each; a text holding an item several times
is reported once per item, at its first best place.  An item too short for an
error must occur exactly, as whole words.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, texts

_RUN = re.compile(r"[^\W_]+")
_OTHER = re.compile(r"[^\w\x00-\x7f]+")
_ASCII = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
WORD = 64


def normal(text: str) -> str:
    """Lower-case letters and digits, everything between them one space."""
    text = text.lower()
    if not text.isascii() and _OTHER.search(text):
        text = _OTHER.sub(" ", text)
    raw = text.encode("utf-8", "surrogatepass").translate(_ASCII)
    return b" ".join(raw.split()).decode("utf-8", "surrogatepass")


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces covering the item, with their offsets."""
    at = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:])]


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a substring of ``text``, and where that first ends.

    Bit i of the words stands for row i of the distance matrix; Python's integers
    hold a pattern of any length in one word.  ``anchored``: substrings start
    where the text does.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top, up = (1 << m) - 1, 1 << (m - 1), int(anchored)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        rise, fall = minus | (full & ~(diagonal | plus)), plus & diagonal
        score += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | up) & full, (fall << 1) & full
        plus, minus = fall | (full & ~(eq | minus | rise)), rise & (eq | minus)
        if score < best:
            best, end = score, j
    return best, end


@dataclass
class Pattern:
    """An item's normal form and the edits it may be matched with."""

    item: int
    text: str
    budget: int


def groups(cuts: list[tuple[int, str]]) -> list[tuple[int, int, int, int]]:
    """Runs of neighbouring pieces of at most WORD characters: (first piece, pieces, start, length)."""
    out, at = [], 0
    while at < len(cuts):
        n, length = 1, len(cuts[at][1])
        while at + n < len(cuts) and length + len(cuts[at + n][1]) <= WORD:
            length += len(cuts[at + n][1])
            n += 1
        out.append((at, n, cuts[at][0], length))
        at += n
    return out


class Matcher:
    """Finds items in texts; built once per Python worker from the broadcast items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.patterns = [Pattern(i, t, int(rate * len(t))) for i, t in items]
        hits: dict[str, list[tuple[int, int, int]]] = {}
        letters, edits, lengths = [], [], []
        for k, p in enumerate(self.patterns):
            cuts = pieces(p.text, p.budget)
            for first, n, start, length in groups(cuts):
                g = len(lengths) if length <= WORD else -1      # a single piece longer than a word needs no check
                for offset, piece in cuts[first:first + n]:
                    hits.setdefault(piece, []).append((k, offset, g, offset - start))
                if g >= 0:
                    letters.append(np.zeros(WORD, np.uint32))
                    letters[-1][:length] = [ord(c) for c in p.text[start:start + length]]
                    edits.append(n - 1), lengths.append(length)
        self.letters = np.array(letters, np.uint32).reshape(-1, WORD)
        self.edits, self.lengths = np.array(edits, np.int64), np.array(lengths, np.int64)
        self.automaton = ahocorasick.Automaton()
        for piece, where in hits.items():
            self.automaton.add_word(piece, (len(piece), where))
        if hits:
            self.automaton.make_automaton()

    def _group_near(self, points: np.ndarray, group: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether each hit's group is within its edits around ``start`` (its place when nothing is shifted)."""
        out = np.ones(len(group), bool)
        for at in range(0, len(group), 20_000):
            g = group[at:at + 20_000]
            check = np.flatnonzero((g >= 0) & (self.edits[g] > 0))
            if len(check):
                g = g[check]
                out[at + check] = self._word_distance(points, g, start[at + check]) <= self.edits[g]
        # groups of one piece are matched by the hit itself
        return out

    def _word_distance(self, points, g, start):
        """Myers' distance in one word: the group's letters against its window of ``points``."""
        edits, m = self.edits[g], self.lengths[g]
        letters = self.letters[g]
        inside = np.arange(WORD) < m[:, None]
        top = np.uint64(1) << (m - 1).astype(np.uint64)
        one = np.uint64(1)
        pv, mv = np.full(len(g), ~np.uint64(0)), np.zeros(len(g), np.uint64)
        score, best = m.copy(), m.copy()
        begin, steps = start - edits, m + 2 * edits
        for t in range(int(steps.max())):
            place = begin + t
            letter = points[np.clip(place, 0, len(points) - 1)]
            letter = np.where((place >= 0) & (place < len(points)), letter, 0)
            eq = np.packbits((letters == letter[:, None]) & inside, axis=1, bitorder="little").view(np.uint64).ravel()
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            score += ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0)
            ph, mh = ph << one, mh << one
            pv, mv = mh | ~(xv | ph), ph & xv
            best = np.where(t < steps, np.minimum(best, score), best)
        return best

    def find(self, values: list[str]) -> list[list[tuple]]:
        """Per text: (item, distance, start, end) of each item within its budget, in code points of the text."""
        out: list[list[tuple]] = [[] for _ in values]
        if not self.patterns:
            return out
        plain = [normal(t) for t in values]
        base, total = [], 0
        row, pattern, place, group, shift = [], [], [], [], []
        for r, text in enumerate(plain):
            base.append(total)
            for last, (length, where) in self.automaton.iter(text):
                at = last + 1 - length
                for k, offset, g, inner in where:
                    row.append(r), pattern.append(k), place.append(at - offset), group.append(g), shift.append(at - inner)
            total += len(text) + WORD * 2        # texts are kept apart by more than a group's window
        if not row:
            return out
        points = np.frombuffer(("\0" * (WORD * 2)).join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        start = np.array(shift, np.int64) + np.array(base, np.int64)[row]
        near = np.flatnonzero(self._group_near(points, np.array(group, np.int64), start))
        places: dict[tuple[int, int], set[int]] = {}
        for i in near.tolist():
            places.setdefault((row[i], pattern[i]), set()).add(place[i])
        for (r, k), starts in places.items():
            found = self._best(plain[r], self.patterns[k], sorted(starts))
            if found:
                distance, a, b = found
                out[r].append((self.patterns[k].item, distance, *_in_text(values[r], a, b)))
        return out

    @staticmethod
    def _best(text: str, p: Pattern, starts: list[int]) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best first place of ``p`` near the starts."""
        best = None
        for lo, hi in _runs(starts, p.budget):
            a = max(0, lo - p.budget)
            window = text[a:max(a, hi + len(p.text) + p.budget)]
            at = window.find(p.text)
            if at >= 0:
                found = (0, a + at, a + at + len(p.text))
            else:
                distance, end = myers(p.text, window)
                if distance > p.budget:
                    continue
                # the start: from the end backwards, anchored there
                found = (distance, a + end - myers(p.text[::-1], window[:end][::-1], anchored=True)[1], a + end)
            if p.budget == 0 and not _whole_words(text, found[1], found[2]):
                continue
            best = found if best is None else min(best, found)
        return best


def _runs(starts: list[int], budget: int):
    """Windows starts at most ``budget`` apart, taken together."""
    lo = hi = starts[0]
    for s in starts[1:]:
        if s - hi > budget:
            yield lo, hi
            lo = s
        hi = s
    yield lo, hi


def _whole_words(text: str, start: int, stop: int) -> bool:
    return (start == 0 or text[start - 1] == " ") and (stop == len(text) or text[stop] == " ")


def _in_text(text: str, start: int, stop: int) -> tuple[int, int]:
    """Span of the original text behind [start, stop) of its normal form."""
    at, out, end = 0, None, 0
    for m in _RUN.finditer(text):
        width = len(m.group().lower())
        if out is None and at + width > start:
            out = m.start() + min(start - at, len(m.group())) if start > at else m.start()
        if at + width >= stop:
            end = m.start() + min(stop - at, len(m.group())) if stop > at else max(end, m.start())
            break
        end = m.end()
        at += width + 1
    return (out or 0), end


#: The last automaton of this worker, by the contents it was built from: a list's address is taken again by the next.
_MATCHERS: dict[tuple[str, float], Matcher] = {}


def digest(items: list[tuple[int, str]]) -> str:
    """Names a block by what it holds."""
    return hashlib.sha256(repr(items).encode("utf-8", "surrogatepass")).hexdigest()


def _matcher(shared, name: str, rate: float) -> Matcher:
    key = (name, rate)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(shared.value, rate)
    return _MATCHERS[key]


def benchmark_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text",
                     block_chars: int = 8_000_000) -> list[list[tuple[int, str]]]:
    """The items in blocks of about ``block_chars`` characters, each fetched by itself."""
    items = benchmark.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.char_length("t"))).first()[0] or 0
    n = int(total // block_chars) + 1
    out = []
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()
        block = sorted({(r["i"], normal(r["t"])) for r in rows}, key=lambda x: (x[0] is None, x))
        out.append([x for x in block if x[1]])
    return [b for b in out if b]


HIT = "array<struct<item_id: long, distance: int, start: int, end: int>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def with_leaks(docs: DataFrame, items: list[tuple[int, str]], rate: float = 0.1, text: str = "text",
               to: str = "_leaks") -> DataFrame:
    """``docs`` with the items of one block that each text holds."""
    shared, name = docs.sparkSession.sparkContext.broadcast(items), digest(items)

    def find(column):
        matcher, values, out = _matcher(shared, name, rate), texts(column), []
        for at in range(0, len(values), 256):
            for hits in matcher.find(values[at:at + 256]):
                out.append([dict(zip(("item_id", "distance", "start", "end"), h)) for h in sorted(hits, key=str)])
        return pa.array(out, _HIT)

    return docs.withColumn(to, F.arrow_udf(find, HIT)(F.col(text).cast("string")))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, text: str = "text",
               doc_id: str = "doc_id", block_chars: int = 8_000_000) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, distance, start, end."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "doc_id long, item_id long, distance int, start int, end int")
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    for block in benchmark_blocks(benchmark, block_chars=block_chars):
        hits = with_leaks(narrow, block, rate).select("doc_id", F.explode("_leaks").alias("h")).select("doc_id", "h.*")
        out = out.unionByName(hits)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, text: str = "text") -> DataFrame:
    """``docs`` without those that hold a benchmark item; no shuffle."""
    leaks = fresh_name(docs, "_leaks")
    for block in benchmark_blocks(benchmark):
        docs = with_leaks(docs, block, rate, text, to=leaks).where(F.size(leaks) == 0).drop(leaks)
    return docs
