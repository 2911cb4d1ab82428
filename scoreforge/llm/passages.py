"""Substring near-duplicates by compact windows.

A text is a sequence of word shingles (five words).  Under a random order of
shingles, every subsequence has a smallest one; the Cartesian tree of the orders groups all
subsequences of at least ``least`` words that share their smallest shingle into
compact windows (l, c, r): the ones that start in [l, c] and end in [c, r].
Windows of different texts with an equal shingle at c are joined; a pair of texts is
a candidate where the windows of enough orders overlap in both texts.  Candidates
are verified on their shingles: passages of at least ``least`` words whose
shingle sets have a Jaccard similarity of ``similarity`` or more.

Equal texts are one text: its copies only come back as members.  Windows with one key are
linked to the first three windows and to the two before, in order of texts, so a passage
that very many texts share gives rows in proportion to its occurrences; keys that a sample of the
texts shows to be frequent are dealt over several tasks, whose first rows are then linked.
Keys with more windows have pairs left: a second look tries every one of them where a window lies in no passage found so
far or the texts are in different classes, in groups of two blocks of windows.  One order is enough there; windows of one
text that overlap are tried as one range, shared shingles, bit maps and the order and density of the shared shingles leave out
pairs that cannot have a passage, and the same check of the shingles decides.  Its work is quadratic in the texts of a key that stay apart.
A class is joined over these links, not over all pairs of its texts: ``n_links`` counts the links found on the way.

Result: one row per document and passage, with the class its text belongs to by such links.

Defined cases: null or empty texts and texts of fewer than ``least`` words have no passage; a text
that several documents hold is a passage as a whole; rows repeating an id are members each;
a null id is carried along and names a class only if no other id can; repeats inside one text are not
reported; words are runs of other than ASCII white space, ASCII letters lower-cased.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import all_chunks, materialise, partitions_of
from .components import connected_components

SHINGLE = 5
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = " \t\n\x0b\x0c\r"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shingles(text: str) -> np.ndarray:
    """A 64-bit hash of every five-word shingle, in order."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if len(words) < SHINGLE:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        out = out * _MULTIPLIER + h[k:len(out) + k]
    return _mix(out)


def order_keys(hashes: np.ndarray, order: int) -> np.ndarray:
    """The hashes under one of the random orders; equal shingles have equal keys."""
    return _mix(hashes + np.uint64(order + 1) * _MULTIPLIER)


def compact_windows(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int):
    """(l, c, r) of all compact windows of the ranges [starts, ends), r inclusive.

    The Cartesian trees of all ranges are walked down together, level by level:
    the smallest key of a range splits it, parts shorter than ``least`` end.
    """
    order = np.argsort(keys)
    new = np.concatenate([[False], np.diff(keys[order]) != 0])
    place = np.empty(len(keys), np.int64)                    # equal keys have one rank; the first place is the smallest
    place[order] = np.cumsum(new) << 32
    place += np.arange(len(keys))
    lo, hi, shift = starts, ends, np.zeros(len(starts), np.int64)      # a range stands ``shift`` further back in ``place``
    left, center, right = [], [], []
    while True:
        long = hi - lo >= least
        lo, hi, shift = lo[long], hi[long], shift[long]
        if not len(lo):
            break
        sizes = hi - lo
        if 2 * (total := int(sizes.sum())) < len(place):     # most of ``place`` is in no range any more
            begin = np.cumsum(sizes) - sizes
            place = place[np.arange(total) + np.repeat(lo - shift - begin, sizes)]
            shift = lo - begin
        edges = np.stack([lo - shift, hi - shift], axis=1).ravel()
        if edges[-1] == len(place):
            edges = edges[:-1]
        c = np.minimum.reduceat(place, edges)[::2] & 0xFFFFFFFF
        left.append(lo), center.append(c), right.append(hi - 1)
        lo, hi = np.stack([lo, c + 1], axis=1).ravel(), np.stack([c, hi], axis=1).ravel()
        shift = np.repeat(shift, 2)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(left), join(center), join(right)


_WINDOW = pa.schema([("key", pa.int64()), ("fn", pa.int32()), ("th", pa.int64()), ("l", pa.int32()), ("c", pa.int32()),
                     ("r", pa.int32())])


def _windows(orders: int, least: int):
    span = least - SHINGLE + 1

    def run(batches):
        for batch in all_chunks(batches, "text"):
            th = batch.column("th").to_numpy()
            hashes = [shingles(t or "") for t in batch.column("text").to_pylist()]
            sizes = np.array([len(h) for h in hashes], np.int64)
            ends = np.cumsum(sizes)
            starts, flat = ends - sizes, np.concatenate(hashes)
            for k in range(orders):
                keys = order_keys(flat, k)
                l, c, r = compact_windows(keys, starts, ends, span)
                doc = np.searchsorted(ends, c, side="right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[c].view(np.int64)), pa.array(np.full(len(c), k, np.int32)), pa.array(th[doc]),
                     *(pa.array((x - starts[doc]).astype(np.int32)) for x in (l, c, r))], schema=_WINDOW)
    return run


_LINK = "a long, b long, fn int, al int, ac int, ar int, bl int, bc int, br int, key long, side int"
_LINK_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), *((n, pa.int32()) for n in ("fn", "al", "ac", "ar", "bl", "bc", "br")),
                         ("key", pa.int64()), ("side", pa.int32())])


def _join_windows(firsts: int = 3, lasts: int = 2):
    """Task: windows sorted by key, salt and text; each is linked to its group's first windows and to those just before.

    A group of up to ``firsts`` + ``lasts`` windows has all its pairs so.  The windows of a larger one are marked, each once
    (or again where a batch ends), for ``_second_look``: ``side`` holds 1 for the window of ``a`` and 2 for that of ``b``.  Every
    window of a salted group is marked; its first one is also returned as a link with itself.  Windows of one text alone have no
    pairs: they are not marked, unless their group goes on from or to another batch.
    """
    complete = firsts + lasts

    def run(batches):
        held = None                            # rows of the group that may go on from the batch before
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = {f: batch.column(f).to_numpy() for f in ("key", "salt", "fn", "th", "l", "c", "r")}
            carried = 0
            if held is not None:
                carried = len(held["key"])
                rows = {f: np.concatenate([held[f], v]) for f, v in rows.items()}
            th, every = rows["th"], np.arange(len(rows["th"]))
            group = np.concatenate([[True], (np.diff(rows["key"]) != 0) | (np.diff(rows["salt"]) != 0)])
            first = np.maximum.accumulate(np.where(group, every, 0))
            at = every[carried:]
            place, salted = at - first[at], rows["salt"][at] >= 0
            starts = np.flatnonzero(group)
            sizes = np.diff(starts, append=len(th))
            alone = (th[starts] == th[starts + sizes - 1]) & (rows["salt"][starts] < 0)
            alone[-1] = False
            if carried:
                alone[0] = False
            apart = ~np.repeat(alone, sizes)[at]
            here, there, mine, other = [], [], [], []     # the windows of a link, and whether each is marked
            for k in range(complete):
                ok = place > k if k < firsts else place > firsts + complete - 1 - k
                here.append(at[ok])
                there.append(first[at[ok]] + k if k < firsts else at[ok] - (complete - k))
                mine.append((apart & (salted | (place >= complete)))[ok] & (k == 0)), other.append((apart & (place == complete) & ~salted)[ok])
            heads = at[group[at] & salted]
            here, there = np.concatenate([*here, heads]), np.concatenate([*there, heads])
            mine, other = np.concatenate([*mine, heads >= 0]), np.concatenate([*other, heads < 0])
            wanted = (th[here] != th[there]) | mine | other
            here, there, mine, other = here[wanted], there[wanted], mine[wanted], other[wanted]
            swap = th[there] > th[here]
            a, b = np.where(swap, here, there), np.where(swap, there, here)
            side = np.where(swap, mine + 2 * other, other + 2 * mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array(th[a]), pa.array(th[b]), pa.array(rows["fn"][a].astype(np.int32)),
                 *(pa.array(rows[f][x].astype(np.int32)) for x in (a, b) for f in ("l", "c", "r")), pa.array(rows["key"][a]),
                 pa.array(side.astype(np.int32))], schema=_LINK_ARROW)
            start, end = int(first[-1]), int(every[-1])
            keep = sorted({*range(start, min(start + firsts, end + 1)), *range(max(start, end + 1 - lasts), end + 1)})
            held = {f: v[keep] for f, v in rows.items()}
    return run


#: Shingles that the windows compared in one group hold at most on either side, about; and 64-bit words of a window's bit map.
_BLOCK, _WORDS = 500_000, 32

_CONTENT = pa.schema([("key", pa.int64()), ("blocks", pa.int32()), ("th", pa.int64()), ("root", pa.int64()), ("open", pa.int32()),
                      ("l", pa.int32()), ("c", pa.int32()), ("content", pa.binary())])
_PART_ROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), *((n, pa.int32()) for n in ("al", "ar", "bl", "br")),
                       ("jaccard", pa.float64())])


def _contents(block: int):
    """Task: texts with their windows; returns the windows with their shingles, each with those only that the windows of
    its key and text before it do not hold."""
    def run(batches):
        for batch in all_chunks(batches, "text"):
            hashes = [shingles(t) for t in batch.column("text").to_pylist()]
            lists = batch.column("rows")
            owner = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy())
            rows = lists.flatten()
            of = {f: rows.field(f).to_numpy(zero_copy_only=False) for f in ("key", "blocks", "open", "l", "c", "r")}
            order = np.lexsort((of["l"], of["key"], owner))
            owner, of = owner[order], {f: v[order] for f, v in of.items()}
            th, root = (batch.column(f).to_numpy()[owner] for f in ("th", "root"))
            if len(owner):
                same = (np.diff(owner) == 0) & (np.diff(of["key"]) == 0)
                far, number = int(of["r"].max()) + 1, np.concatenate([[0], np.cumsum(~same)])
                stop = of["r"].astype(np.int64) + 1 + number * far
                done = np.concatenate([[0], np.maximum.accumulate(stop)[:-1]]) - number * far
                of["l"] = np.maximum(of["l"], done).astype(np.int32)
            size = np.cumsum(np.maximum(of["r"].astype(np.int64) - of["l"] + 1, 0))
            for at in np.split(np.arange(len(size)), np.flatnonzero(np.diff(size // block)) + 1):
                held = [hashes[o][l:r + 1].tobytes() for o, l, r in zip(owner[at], of["l"][at], of["r"][at])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of["key"][at]), pa.array(of["blocks"][at]), pa.array(th[at]), pa.array(root[at]),
                     *(pa.array(of[f][at]) for f in ("open", "l", "c")), pa.array(held, pa.binary())], schema=_CONTENT)
    return run


def bit_map(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """A bit map of shingles, and how many fewer bits than shingles it has."""
    seen = np.zeros(64 * _WORDS, bool)
    seen[(hashes & np.uint64(64 * _WORDS - 1)).astype(np.int64)] = True
    return np.packbits(seen).view(np.uint64), len(hashes) - int(np.count_nonzero(seen))


def numbered(contents: list) -> list:
    """The contents with every repeat of a shingle as one of its own: two of them share as many as a chain of links can have."""
    sizes = np.array([len(h) for h in contents])
    flat, of = np.concatenate(contents), np.repeat(np.arange(len(contents), dtype=np.int32), sizes)
    order = np.argsort(flat, kind="stable")
    value, owner = flat[order], of[order]
    again = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
    if again.any():
        every = np.arange(len(flat))
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ~again]), every, 0))
        flat = flat.copy()
        flat[order] = value + (every - first).astype(np.uint64) * _MULTIPLIER
    return np.split(flat, np.cumsum(sizes)[:-1])


def shared_ids(contents: list, owner: np.ndarray) -> list:
    """Per content, small numbers of its shingles that also stand in one of another owner."""
    return shared_places(contents, owner)[0]


def shared_places(contents: list, owner: np.ndarray) -> tuple[list, list]:
    """Per content, small numbers of its shingles that also stand in one of another owner, and where they stand."""
    sizes = np.array([len(h) for h in contents])
    of = np.repeat(owner, sizes)
    values, flat = np.unique(np.concatenate(contents), return_inverse=True)
    one, many = np.zeros(len(values), owner.dtype), np.zeros(len(values), bool)
    one[flat] = of
    many[flat[one[flat] != of]] = True
    ids, ok = (np.cumsum(many) - 1).astype(np.uint64)[flat], many[flat]
    starts = np.cumsum(sizes) - sizes
    ends = np.cumsum(np.add.reduceat(ok.astype(np.int64), starts))
    places = (np.arange(len(flat)) - np.repeat(starts, sizes))[ok]
    return np.split(ids[ok], ends[:-1]), np.split(places, ends[:-1])


def patterns(contents: list, owner: np.ndarray) -> list:
    """Contents of which only what ``alike`` sees of two owners' ones is left.

    A shingle that another owner holds too has its number, any other one the distance to its last place before, less than zero.
    """
    sizes = np.array([len(h) for h in contents])
    of, row = np.repeat(owner, sizes), np.repeat(np.arange(len(sizes)), sizes)
    values, flat = np.unique(np.concatenate(contents), return_inverse=True)
    one, many = np.zeros(len(values), owner.dtype), np.zeros(len(values), bool)
    one[flat] = of
    many[flat[one[flat] != of]] = True
    order = np.argsort(flat, kind="stable")
    again = np.concatenate([[False], (np.diff(flat[order]) == 0) & (np.diff(row[order]) == 0)])
    back = np.full(len(flat), -len(flat), np.int64)
    back[order[again]] = order[np.flatnonzero(again) - 1] - order[again]
    return np.split(np.where(many[flat], flat, back), np.cumsum(sizes)[:-1])


def pattern_of(pattern: np.ndarray) -> bytes:
    """A part of a pattern in which shingles whose last place lies before the part are new."""
    return np.where(pattern < -np.arange(len(pattern)), np.iinfo(np.int64).min, pattern).tobytes()


def may_hold(ids: list, places: list, i: int, others: np.ndarray, table: np.ndarray, fewest: int, similarity: float) -> np.ndarray:
    """Which of the others may have a passage in common with content ``i``; contents repeat no shingle.

    Their shared shingles are one chain if they stand in one order.  Then a passage pair is a stretch of ``fewest`` links or
    more over which the sum of ``_longest`` does not fall; contents in other order may have one in any case.
    ``table`` holds -1 for every number of a shingle.
    """
    table[ids[i]] = places[i]
    sizes = np.array([len(ids[j]) for j in others])
    x = table[np.concatenate([ids[j] for j in others])]
    table[ids[i]] = -1
    hit = x >= 0
    x, y, of = x[hit], np.concatenate([places[j] for j in others])[hit], np.repeat(np.arange(len(others)), sizes)[hit]
    found = np.zeros(len(others), bool)
    if len(x) < fewest:
        return found
    found[of[1:][(np.diff(of) == 0) & (np.diff(x) < 0)]] = True
    gain = (1 + similarity) * (np.arange(len(x)) - np.searchsorted(of, np.arange(len(others)))[of]) - similarity * (x + y)
    fall = of * (float(gain.max() - gain.min()) + 1)         # sums of the contents before never are the least
    least = np.minimum.accumulate(gain - fall)[:1 - fewest] + fall[:1 - fewest]
    last = of[fewest - 1:]
    found[last[(last == of[:1 - fewest]) & (gain[fewest - 1:] - least >= similarity - 1 - 1e-3)]] = True
    return found


def thickest(hits: np.ndarray, span: int) -> float:
    """The largest part of hits in a stretch of ``span`` to twice as many; longer stretches hold one with no smaller part."""
    n, sums = len(hits), np.concatenate([[0], np.cumsum(hits)])
    lengths = np.arange(span, min(2 * span, n + 1))
    stops = np.minimum(np.arange(n) + lengths[:, None], n)
    return float(((sums[stops] - sums[:-1]).max(axis=1) / lengths).max(initial=0.0))


def reaches(hits: np.ndarray, span: int, similarity: float) -> bool:
    """Whether a stretch of ``span`` or more from a hit to a hit has ``similarity`` of its places as hits."""
    x = np.flatnonzero(hits)
    before = np.searchsorted(x, x - span + 1, side="right") - 1
    gain = np.arange(len(x)) - similarity * x
    far = before >= 0
    return bool((gain[far] - np.minimum.accumulate(gain)[before[far]] >= similarity - 1 - 1e-6).any())


def unlike(a: np.ndarray, b: np.ndarray, table: np.ndarray, span: int, similarity: float) -> bool:
    """Whether two patterns surely have no passage: n links are n places on either side, of p and q in all with (p + q) / n at most (1 + s) / s."""
    rest = len(table) - 1                                     # shingles that no other owner has
    a, b = (np.where(h < 0, rest, h) for h in (a, b))
    hits = []
    for of, other in ((a, b), (b, a)):
        table[other] = True
        table[rest] = False
        hits.append(table[of])
        table[other] = False
    if not all(reaches(h, span, similarity) for h in hits):
        return True
    if max(len(a), len(b)) > 1024:
        return False
    return sum(1 / max(thickest(h, span), 1e-9) for h in hits) > (1 + similarity) / similarity + 1e-6


class _Range:
    """Windows of one text that overlap or touch, as the one stretch of shingles they span."""

    def __init__(self, th, members: np.ndarray, l, c, loose, contents: list):
        ends = l[members] + np.array([len(contents[i]) for i in members])
        self.th, self.low, self.high = th, int(l[members[0]]), int(ends.max())
        pieces, done = [], self.low
        for i, start, end in zip(members.tolist(), l[members].tolist(), ends.tolist()):          # in order of their starts
            if end > done:
                pieces.append(contents[i][done - start:])
                done = end
        self.content = pieces[0] if len(pieces) == 1 else np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
        self.places, self.loose = c[members].astype(np.int64), loose[members]
        self.repeats, self.pieces, self.pattern, self.names = None, None, None, {}

    def left(self, seen: _Covered, reach: int) -> tuple[int, int] | None:
        """The part around the windows' smallest shingles that are still not covered."""
        bare = self.places[self.loose & ~seen.at(self.places)]
        return (max(self.low, int(bare.min()) - reach), min(self.high, int(bare.max()) + reach + 1)) if len(bare) else None


    def parts(self, span: int) -> list:
        """Places of smallest shingles, ``span`` / 2 apart at least, each with the part of two passages' length on either side."""
        if self.pieces is None:
            self.pieces, last = [], -span
            for k in sorted(set(self.places.tolist())):
                if k - last >= span // 2:
                    self.pieces.append(((k, k + span // 2), (max(self.low, k - 2 * span), min(self.high, k + 2 * span + 1))))
                    last = k
        return self.pieces

    def bare(self, seen: _Covered, part: tuple[int, int]) -> bool:
        """Whether an open smallest shingle from ``part`` is still not covered."""
        own = self.places[(self.places >= part[0]) & (self.places < part[1]) & self.loose]
        return not seen.at(own).all()


class _Covered:
    """The places of one text that lie in passages found."""

    def __init__(self, ranges: list):
        self.low = min(min(r.low, int(r.places.min())) for r in ranges)
        self.seen = np.zeros(max(max(r.high, int(r.places.max()) + 1) for r in ranges) - self.low, bool)

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.seen[places - self.low]

    def add(self, start: int, stop: int) -> bool:
        """Takes in a passage; whether a part of it is new."""
        part = self.seen[start - self.low:stop - self.low]
        new = not part.all()
        part[:] = True
        return new


def _ranges(th, block, loose, l, c, contents) -> tuple[list, np.ndarray]:
    """The windows of every text as ranges, and the block of each."""
    ends = l.astype(np.int64) + np.array([len(h) for h in contents])
    order = np.lexsort((l, th))
    texts, number = np.unique(th[order], return_inverse=True)
    far = int(ends.max()) + 1
    reach = np.maximum.accumulate(ends[order] + number * far)
    cut = np.flatnonzero(l[order][1:] + number[1:] * far > reach[:-1]) + 1
    parts = np.split(order, cut)
    return [_Range(th[m[0]], m, l, c, loose, contents) for m in parts], block[[m[0] for m in parts]]


def sharing(contents: list, owner: np.ndarray, fewest: int) -> np.ndarray:
    """Places of the contents of which ``fewest`` shingles or more also stand in one of another owner, or may do so.

    Shingles are looked up in a table by their last bits, so some too many are taken as shared, none too few.
    """
    at, sizes = np.arange(len(contents)), np.array([len(h) for h in contents])
    while len(at):
        flat, of = np.concatenate([contents[i] for i in at]), np.repeat(owner[at].astype(np.int32), sizes[at])
        bits = (8 * len(flat)).bit_length()
        place = (flat & np.uint64((1 << bits) - 1)).astype(np.int64)
        one, many = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, bool)
        one[place] = of
        many[place[one[place] != of]] = True
        kept = np.add.reduceat(many[place].astype(np.int64), np.cumsum(sizes[at]) - sizes[at]) >= fewest
        at = at[kept]
        if kept.all():
            break
    return at


def all_alike(th, root, loose, l, c, contents, block, span: int, similarity: float):
    """Passages of the pairs of windows of different texts (and blocks, if there are two), by trying every pair.

    Windows of one text that overlap or touch are tried as the range they span, and again over what is left of it as long as that covers
    more.  Left out are only pairs whose windows all lie in passages found and whose texts are in one class already.
    A passage pair has a chain of ``fewest`` shingles at least in both ranges, repeats counted as often as both have them:
    ranges with fewer that others hold are left out at once, in time linear in their shingles.  Of the rest, n shared shingles
    of a range set n bits less those that its map is short of, or more, so a pair with fewer bits in common has no passage.

    Passages that lie in those returned before are left out where the two texts are linked already.
    """
    fewest = int(np.ceil(similarity * 2 * span / (1 + similarity) - 1e-6))
    ranges, block = _ranges(th, block, loose, l, c, contents)
    two = block.min() != block.max()
    names, text = np.unique([r.th for r in ranges], return_inverse=True)
    owner = (block if two else text).astype(np.int32)
    each = numbered([r.content for r in ranges])
    at = sharing(each, owner, fewest)
    if len(at) < 2:
        return []
    ids, where = shared_places([each[i] for i in at], owner[at])
    enough = np.flatnonzero(np.array([len(h) for h in ids]) >= fewest)
    if len(enough) < 2:
        return []
    ids, where, at = [ids[i] for i in enough], [where[i] for i in enough], at[enough]
    ranges, text, block = [ranges[i] for i in at], text[at], block[at]
    for r, k, pattern in zip(ranges, at.tolist(), patterns([r.content for r in ranges], owner[at])):
        r.pattern, r.repeats = pattern, not np.array_equal(each[k], r.content)
    table = np.full(int(max(h.max() for h in ids)) + 1, -1, np.int64)
    other_of = np.zeros(max(int(r.pattern.max()) for r in ranges) + 2, bool)
    plain = np.array([not r.repeats and r.high - r.low <= 4 * span + 1 for r in ranges])
    maps, short = np.zeros((_WORDS, len(at)), np.uint64), np.zeros(len(at), np.int64)
    for i, h in enumerate(ids):
        maps[:, i], short[i] = bit_map(h)
    loose = np.array([r.loose.any() for r in ranges])
    class_of = dict(zip(th.tolist(), root.tolist()))
    own = np.unique([class_of[r.th] for r in ranges], return_inverse=True)[1]    # classes as small numbers, joined as passages are found
    ranges_of = np.split(np.argsort(text, kind="stable"), np.cumsum(np.bincount(text, minlength=len(names)))[:-1])
    covered: dict[int, _Covered] = {}
    out, linked, known, apart_of, alikes = [], set(), {}, {}, {}
    same = [alikes.setdefault(pattern_of(r.pattern), len(alikes)) for r in ranges]

    def seen(i: int) -> _Covered:
        if (held := covered.get(text[i])) is None:
            held = covered[text[i]] = _Covered([ranges[k] for k in ranges_of[text[i]]])
        return held

    def name(r: _Range, part: tuple[int, int]) -> int:
        """The number of a part's pattern: parts of one have the same passages in common with others."""
        if (held := r.names.get(part)) is None:
            held = r.names[part] = alikes.setdefault(pattern_of(r.pattern[part[0] - r.low:part[1] - r.low]), len(alikes))
        return held

    def hopeless(x: int, y: int, of_x: tuple[int, int], of_y: tuple[int, int]) -> bool:
        """Whether no parts of these two have a passage."""
        names = name(ranges[x], of_x), name(ranges[y], of_y)
        if (held := apart_of.get(names)) is None:
            held = apart_of[names] = unlike(*(r.pattern[s - r.low:e - r.low] for r, (s, e) in ((ranges[x], of_x), (ranges[y], of_y))),
                                            other_of, span, similarity)
        return held

    def both(x: int, y: int, of_x: tuple[int, int], of_y: tuple[int, int]) -> list:
        again = ranges[x].repeats or ranges[y].repeats
        cut = [(r, slice(s - r.low, e - r.low)) for r, (s, e) in ((ranges[x], of_x), (ranges[y], of_y))]
        if again and hopeless(x, y, of_x, of_y):
            return []
        a, b = (r.content[part] for r, part in cut)
        found = alike(a, b, span, similarity, single=not again)
        if again:
            found = found + [f for f in alike(a, b, span, similarity, counted=True) if f not in found]
        return found

    def tried(x: int, y: int, of_x: tuple[int, int], of_y: tuple[int, int], found: list) -> bool:
        """Takes in the passages found in parts of two ranges; whether they cover more than those before."""
        more, apart = False, own[x] != own[y]
        for s, e, u, v, jaccard in found:
            s, e, u, v = of_x[0] + s, of_x[0] + e, of_y[0] + u, of_y[0] + v
            held = [((r.places >= a) & (r.places < b)).any() for r, a, b in ((ranges[x], s, e), (ranges[y], u, v))]
            if not (any(held) or apart):
                continue                                         # it lies in the windows of its own shingles
            new = [seen(x).add(s, e), seen(y).add(u, v)]
            if any(new) or (text[x], text[y]) not in linked:
                out.append((ranges[x].th, ranges[y].th, s, e, u, v, jaccard))
                linked.add((text[x], text[y]))
            more |= any(new)
        if more:
            for i in (x, y):
                for k in ranges_of[text[i]]:
                    loose[k] = loose[k] and ranges[k].left(seen(k), 2 * span) is not None
        if found and apart:
            own[own == own[x]] = own[y]
        return more

    def left_over(here: np.ndarray, there: np.ndarray):
        """The pairs that may have a passage still looked for."""
        for i, others in zip(here[np.flatnonzero(np.diff(here, prepend=-1))].tolist(), np.split(there, np.flatnonzero(np.diff(here)) + 1)):
            if not loose[i]:
                others = others[loose[others] | (own[others] != own[i])]
            if plain[i] and (known_order := plain[others]).any():
                wanted = ~known_order
                wanted[known_order] = may_hold(ids, where, i, others[known_order], table, fewest, similarity)
                others = others[wanted]
            for j in others.tolist():
                yield i, j

    for begin in range(0, len(at), 64):
        i, j = np.arange(begin, min(begin + 64, len(at)))[:, None], np.arange(min(begin + 64, len(at)))
        near = (j < i) & (text[i] != text[j]) & (loose[i] | loose[j] | (own[i] != own[j]))
        if two:
            near &= block[i] != block[j]
        if not near.any():
            continue
        common = np.zeros(near.shape, np.int32)
        for w in range(_WORDS):
            common += np.bitwise_count(maps[w, i] & maps[w, j])
        near &= common >= fewest - np.minimum(short[i], short[j])
        here, there = np.nonzero(near)
        best = np.lexsort((-common[here, there], here))
        for i, j in left_over((here[best] + begin), there[best]):
            if not loose[i] and not loose[j] and own[i] == own[j]:
                continue
            x, y = (i, j) if ranges[i].th < ranges[j].th else (j, i)
            a, b = ranges[x], ranges[y]
            of_x, of_y = (a.low, a.high), (b.low, b.high)
            if (found := known.get((same[x], same[y]))) is None:
                found = known[same[x], same[y]] = both(x, y, of_x, of_y)
            while found and tried(x, y, of_x, of_y, found) and (loose[x] or loose[y]):
                parts = [r.left(seen(k), 2 * span) or (r.low, r.high) for k, r in ((x, a), (y, b))]
                if parts == [of_x, of_y]:
                    break
                of_x, of_y = parts
                found = both(x, y, of_x, of_y)
            if not (loose[x] or loose[y]) or max(a.high - a.low, b.high - b.low) <= 4 * span + 1:
                continue
            if not found and hopeless(x, y, (a.low, a.high), (b.low, b.high)):
                continue
            for p, of_x in a.parts(span):                        # repeats hide passages from a look at the whole
                of_p = loose[x] and a.bare(seen(x), p)
                for q, of_y in b.parts(span):
                    if of_p or (loose[y] and b.bare(seen(y), q)):
                        if hopeless(x, y, of_x, (b.low, b.high)):
                            break
                        if (found := known.get(names := (name(a, of_x), name(b, of_y)))) is None:
                            found = known[names] = both(x, y, of_x, of_y)
                        if found and tried(x, y, of_x, of_y, found):
                            of_p = loose[x] and a.bare(seen(x), p)
    return out


def _all_pairs(span: int, similarity: float):
    """Task: windows sorted by key and pair of blocks; returns the passages of each group's pairs."""
    def parts(held):
        rows = pa.concat_tables([pa.Table.from_batches([b]) for b in held]).combine_chunks()
        of = {f: rows.column(f).to_numpy() for f in ("th", "root", "open", "l", "c", "block")}
        contents = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("content")]
        found = all_alike(of["th"], of["root"], of["open"] > 0, of["l"], of["c"], contents, of["block"], span, similarity)
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found), _PART_ROW)], schema=_PART_ROW) if found else None

    def run(batches):
        held, last = [], None
        for batch in batches:
            names = [batch.column(f).to_numpy() for f in ("key", "low", "high")]
            cuts = np.flatnonzero(np.any([np.diff(v) != 0 for v in names], axis=0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if start == stop:
                    continue
                group = tuple(int(v[start]) for v in names)
                if group != last and held:
                    if (done := parts(held)) is not None:
                        yield done
                    held = []
                held.append(batch.slice(start, stop - start))
                last = group
        if held and (done := parts(held)) is not None:
            yield done
    return run


def meeting(group: np.ndarray, fn: np.ndarray, lo: np.ndarray, hi: np.ndarray, enough: int, groups: int) -> np.ndarray:
    """Per group, whether intervals [lo, hi] of ``enough`` orders cover a place together."""
    # intervals of one order that overlap count once: they are merged first
    order = np.lexsort((lo, fn, group))
    g, lo, hi = group[order], lo[order].astype(np.int64), hi[order].astype(np.int64) + 1
    set_id = np.cumsum(np.concatenate([[True], (np.diff(g) != 0) | (np.diff(fn[order]) != 0)])) - 1
    reach = int(hi.max()) + 1
    top = np.maximum.accumulate(hi + set_id * reach) - set_id * reach
    first = np.concatenate([[True], (np.diff(set_id) != 0) | (lo[1:] > top[:-1])])
    at = np.flatnonzero(first)
    ends = top[np.append(at[1:], len(top)) - 1]
    # a sweep over starts and (exclusive) stops, stops first
    place = np.concatenate([lo[at], ends])
    step = np.concatenate([np.ones(len(at), np.int64), -np.ones(len(at), np.int64)])
    owner = np.concatenate([g[at], g[at]])
    order = np.lexsort((step, place, owner))
    open_ = np.cumsum(step[order])             # every group's steps sum to zero, so the sum starts anew
    found = np.zeros(groups, bool)
    found[owner[order][open_ >= enough]] = True
    return found


def _candidates(enough: int):
    """Task: links sorted by pair; where windows of enough orders meet in both texts, the parts all of them span."""
    names = ("a", "b", "fn", "al", "ar", "bl", "br")

    def regions(rows):
        change = np.concatenate([[True], (np.diff(rows["a"]) != 0) | (np.diff(rows["b"]) != 0)])
        pair, head = np.cumsum(change) - 1, np.flatnonzero(change)
        n = len(head)
        ok = (meeting(pair, rows["fn"], rows["al"], rows["ar"], enough, n)
              & meeting(pair, rows["fn"], rows["bl"], rows["br"], enough, n))
        spans = (np.minimum.reduceat(rows["al"], head), np.maximum.reduceat(rows["ar"], head) + 1,
                 np.minimum.reduceat(rows["bl"], head), np.maximum.reduceat(rows["br"], head) + 1)
        return pa.RecordBatch.from_arrays([pa.array(rows["a"][head[ok]]), pa.array(rows["b"][head[ok]]),
                                           *(pa.array(x[ok].astype(np.int32)) for x in spans)],
                                          ["a", "b", "al", "ar", "bl", "br"])

    def run(batches):
        held = None                            # links of the pair that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {f: batch.column(f).to_numpy() for f in names}
            if held is not None:
                rows = {f: np.concatenate([held[f], v]) for f, v in rows.items()}
            other = np.flatnonzero((rows["a"] != rows["a"][-1]) | (rows["b"] != rows["b"][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield regions({f: v[:cut] for f, v in rows.items()})
            held = {f: v[cut:] for f, v in rows.items()}
        if held is not None:
            yield regions(held)
    return run


def alike(a: np.ndarray, b: np.ndarray, span: int, similarity: float, counted: bool = False,
          single: bool = False) -> list[tuple[int, int, int, int, float]]:
    """Passages of two shingle sequences: (a start, a stop, b start, b stop, Jaccard), longest first, not overlapping in ``a``.

    Shared shingles that stand in one order in both texts form a chain, whatever is inserted or left out between them.
    A passage pair of that similarity shares ``similarity`` of either side's shingles or more; the longest stretch of a
    chain that is similar enough over both sides is taken, the rest is searched again.
    Repeated shingles are taken as near each other, or, if ``counted``, in their order: the first as the first one in ``b``.
    ``single`` says that neither side repeats one.
    """
    least = similarity * span
    if len(a) < span or len(b) < span:
        return []
    where_b = np.argsort(b, kind="stable")
    sorted_b = b[where_b]
    place = np.searchsorted(sorted_b, a)
    at = np.flatnonzero(sorted_b[np.minimum(place, len(b) - 1)] == a)
    if len(at) < least:
        return []
    if counted:
        at, near = _in_order(a, at, place[at], where_b, sorted_b)
    elif single:
        near = where_b[place[at]]
    else:
        near = _nearest(a, at, place[at], where_b, sorted_b)
    single = single and bool((np.diff(near) > 0).all())       # then every shared shingle between two links is one
    out, todo = [], [(at, near)]
    while todo:
        at, near = todo.pop()
        if len(at) < least:
            continue
        if single:
            x, y = at, near
        else:
            chain = _chain(near)
            if len(chain) < least:
                continue
            x, y = at[chain], near[chain]
        found = _longest(x, y, span, similarity)
        if found is None and single:
            continue
        if found is None:                      # other places of b may hold what this chain does not
            rest = np.ones(len(at), bool)
            rest[chain] = False
            todo.append((at[rest], near[rest]))
            continue
        i, j = found
        s, e, t, u = int(x[i]), int(x[j]) + 1, int(y[i]), int(y[j]) + 1
        jaccard = (j - i + 1) / (e - s + u - t - (j - i + 1)) if single else _jaccard(a[s:e], b[t:u])
        if jaccard >= similarity:
            out.append((s, e, t, u, jaccard))
            before, after = at < s, at >= e
        else:                                  # repeated shingles count once: the parts beside the widest gap may do
            cut = x[i + 1 + int(np.argmax(np.diff(x[i:j + 1]) + np.diff(y[i:j + 1])))]
            before, after = at < cut, at >= cut
        todo += [(at[before], near[before]), (at[after], near[after])]
    return sorted(out, key=lambda p: p[0] - p[1])


def _nearest(a, at, low, where_b, sorted_b) -> np.ndarray:
    """The place in b of each shared shingle; a repeated one is taken as the shared one nearest in a that has one place."""
    near = where_b[low]
    other = sorted_b[1:] != sorted_b[:-1]
    if other.all():
        return near
    near, high = near.copy(), np.searchsorted(sorted_b, a[at], side="right")
    alone, many = np.flatnonzero(high - low == 1), np.flatnonzero(high - low > 1)
    if not len(many):
        return near
    if len(alone):
        k = np.searchsorted(alone, many)
        before, after = alone[np.maximum(k - 1, 0)], alone[np.minimum(k, len(alone) - 1)]
        by = np.where(np.abs(at[after] - at[many]) < np.abs(at[before] - at[many]), after, before)
        wanted = at[many] + near[by] - at[by]
    else:
        wanted = at[many] + int(np.median(near - at))
    # the places of one shingle ascend, those of all shingles do with the shingle's place in front
    n = len(where_b)
    first = np.maximum.accumulate(np.where(np.concatenate([[True], other]), np.arange(n), 0))
    place = np.searchsorted(first * n + where_b, low[many] * n + np.clip(wanted, 0, n - 1))
    left, right = where_b[np.maximum(place - 1, low[many])], where_b[np.minimum(place, high[many] - 1)]
    near[many] = np.where(np.abs(left - wanted) <= np.abs(right - wanted), left, right)
    return near


def _in_order(a, at, low, where_b, sorted_b) -> tuple[np.ndarray, np.ndarray]:
    """The shared shingles that b holds as often, and the place of each: its first, second, and so on."""
    order = np.argsort(low, kind="stable")
    every, new = np.arange(len(at)), np.concatenate([[True], np.diff(low[order]) != 0])
    number = np.empty(len(at), np.int64)
    number[order] = every - np.maximum.accumulate(np.where(new, every, 0))
    ok = low + number < np.searchsorted(sorted_b, a[at], side="right")
    return at[ok], where_b[(low + number)[ok]]


def _chain(near: np.ndarray) -> np.ndarray:
    """Indices of a longest strictly increasing subsequence."""
    if (np.diff(near) > 0).all():
        return np.arange(len(near))
    tails, last, before = [], [], []
    for i, v in enumerate(near.tolist()):
        k = bisect_left(tails, v)
        before.append(last[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v), last.append(i)
        else:
            tails[k], last[k] = v, i
    out, i = [], last[-1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1])


def _longest(x: np.ndarray, y: np.ndarray, span: int, similarity: float) -> tuple[int, int] | None:
    """First and last link of the longest stretch of a chain with that Jaccard similarity, ``span`` long on both sides.

    n links over lengths p and q have n / (p + q - n): (1 + s) n - s (p + q) >= 0 is a difference of running sums.
    """
    gain = (1 + similarity) * np.arange(len(x)) - similarity * (x + y)
    high = np.maximum.accumulate(gain[::-1])
    ends = len(x) - np.searchsorted(high, gain + similarity - 1 - 1e-9, side="left") - 1
    length = x[ends] - x
    length[(length + 1 < span) | (y[ends] - y + 1 < span)] = -1
    i = int(np.argmax(length))
    return (i, int(ends[i])) if length[i] >= 0 else None


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    x, y = np.unique(a), np.unique(b)
    hit = np.searchsorted(y, x)
    common = int((y[np.minimum(hit, len(y) - 1)] == x).sum())
    return common / (len(x) + len(y) - common)


_PART = "array<struct<al: int, ar: int, bl: int, br: int, jaccard: double>>"
_PART_ARROW = pa.list_(pa.struct([*((n, pa.int32()) for n in ("al", "ar", "bl", "br")), ("jaccard", pa.float64())]))

class _Last:
    """Shingles of the text asked for last: a join's rows come in order of their text."""

    def __init__(self):
        self.text, self.hashes = None, None

    def __call__(self, text: str) -> np.ndarray:
        if text != self.text:
            self.text, self.hashes = text, shingles(text)
        return self.hashes


def _values(*columns, step: int = 256):
    """Rows of Arrow columns as Python values, a few hundred at a time."""
    for start in range(0, len(columns[0]), step):
        yield from zip(*(c.slice(start, step).to_pylist() for c in columns))


def _slice(text, lo, hi):
    of = _Last()
    return pa.array((of(t or "")[a:b].tobytes() for t, a, b in _values(text, lo, hi)), pa.binary())


def _verify(span: int, similarity: float):
    def run(part, lo, text, other_lo, other_hi):
        out, of = [], _Last()
        for p, a0, t, b0, b1 in _values(part, lo, text, other_lo, other_hi):
            found = alike(np.frombuffer(p, np.uint64), of(t or "")[b0:b1], span, similarity)
            out.append([{"al": a0 + s, "ar": a0 + e, "bl": b0 + u, "br": b0 + v, "jaccard": j} for s, e, u, v, j in found])
        return pa.array(out, _PART_ARROW)
    return run


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 50, orders: int = 4,
                      enough: int = 2, similarity: float = 0.8, salts: int = 32, block: int = _BLOCK) -> DataFrame:
    """One row per document and repeated passage: doc_id, class_id, start, stop (words, stop exclusive), n_links.

    ``class_id`` is the smallest id among the documents of all texts linked, ``n_links`` the texts that this
    text was linked to (its copies not counted).
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(
        "text is not null").withColumn("th", F.xxhash64("text"))
    narrow = materialise(rows.select("doc_id", "th"), "passage-texts")
    classes = narrow.groupBy("th").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    spare = materialise(narrow.join(classes.where("copies > 1").select("th", "least"), "th")
                        .where("doc_id > least").select("doc_id", "th").distinct(), "passage-copies")
    single = rows.join(spare, ["doc_id", "th"], "left_anti").select("th", "text")
    span = least - SHINGLE + 1

    # keys that one text in sixty-four shows often: only how rows are dealt depends on them
    shown = single.where(F.pmod("th", F.lit(64)) == 0).mapInArrow(_windows(orders, least), _ddl(_WINDOW))
    hot = materialise(shown.groupBy("key").count().where("count >= 16").orderBy(F.col("count").desc(), "key").limit(4096)
                      .select("key"), "passage-hot")
    windows = single.mapInArrow(_windows(orders, least), _ddl(_WINDOW))
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("th"), F.lit(salts))).otherwise(-1).cast("int")
    windows = windows.join(F.broadcast(hot.withColumn("often", F.lit(True))), "key", "left").withColumn("salt", salt)
    dealt = materialise(_joined(windows, partitions_of(docs)), "passage-links", compression="zstd")
    # the first rows of salted groups, at most 4096 keys times salts, are linked once more by key alone
    heads = dealt.where("a = b and ac = bc and side = 2").select("key", F.lit(-1).alias("salt"), "fn", F.col("a").alias("th"), F.col("al").alias("l"),
                                        F.col("ac").alias("c"), F.col("ar").alias("r"))
    links = dealt.unionByName(_joined(heads, partitions_of(docs))).where("a <> b")

    parts = _verified(links.select("a", "b", "fn", "al", "ar", "bl", "br"), single, enough, span, similarity)
    parts = parts.unionByName(_second_look(dealt, parts, single, span, similarity, block))

    edges = parts.select("a", "b").distinct()
    both = edges.select(F.col("a").alias("th"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("th"), F.col("a").alias("other")))
    n_links = both.groupBy("th").agg(F.count("*").alias("n_links"))
    copied = materialise(classes.where("copies > 1").select("th"), "passage-copied")
    words = F.regexp_count("text", F.lit(f"[^{_SPACE}]+"))        # an aggregate, so that it is counted of the copied texts alone
    whole = (rows.join(copied, "th", "left_semi").groupBy("th").agg(F.min(words).alias("words")).where(F.col("words") >= least)
             .select("th", F.lit(0).alias("start"), F.col("words").cast("int").alias("stop")))
    spans = (parts.select(F.col("a").alias("th"), F.col("al").alias("start"), (F.col("ar") + SHINGLE - 1).alias("stop"))
             .unionByName(parts.select(F.col("b").alias("th"), F.col("bl").alias("start"), (F.col("br") + SHINGLE - 1).alias("stop")))
             .unionByName(whole).distinct())
    spans = _merged(spans)
    roots = connected_components(edges).withColumnRenamed("node", "th")
    named = (spans.select("th").distinct().join(classes.select("th", "least"), "th").join(roots, "th", "left")
             .withColumn("root", F.coalesce("root", "th")))
    least_id = named.groupBy("root").agg(F.min("least").alias("class_id"))
    of_text = named.join(least_id, "root").join(n_links, "th", "left").select(
        "th", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return (narrow.select("doc_id", "th").join(spans.join(of_text, "th"), "th")
            .select("doc_id", "class_id", "start", "stop", "n_links"))


def _verified(links: DataFrame, single: DataFrame, enough: int, span: int, similarity: float) -> DataFrame:
    """Passages (a, b, al, ar, bl, br, jaccard) of the pairs that windows of ``enough`` orders link."""
    pairs = (links.repartition(partitions_of(links), "a", "b").sortWithinPartitions("a", "b")
             .mapInArrow(_candidates(enough), "a long, b long, al int, ar int, bl int, br int"))
    pairs = materialise(pairs, "passage-pairs")
    needed = pairs.select(F.col("a").alias("th")).unionByName(pairs.select(F.col("b").alias("th"))).distinct()
    held = materialise(single.join(needed, "th", "left_semi").dropDuplicates(["th"]), "passage-held", compression="zstd")
    first, second = held.toDF("a", "a_text"), held.toDF("b", "b_text")
    cut = F.arrow_udf(_slice, "binary")("a_text", "al", "ar").alias("part")
    found = F.arrow_udf(_verify(span, similarity), _PART)("part", "al", "b_text", "bl", "br")
    return materialise(pairs.join(first, "a").select("a", "b", "al", "bl", "br", cut).join(second, "b")
                       .select("a", "b", F.explode(found).alias("p")).select("a", "b", "p.*"), "passage-parts")


def _second_look(links: DataFrame, parts: DataFrame, single: DataFrame, span: int, similarity: float, block: int) -> DataFrame:
    """Passages of all pairs of windows of one key that the first links left apart.

    The windows of keys with pairs left are marked in the links.  Of a window, two passages' length on either side of its smallest
    shingle are looked at: what lies further out is in the windows of other shingles.  Pairs are tried where a window lies in no passage found so
    far or the texts are in different classes.  A key of many windows is dealt into blocks by text; every pair of
    blocks is a group of its own, so a task holds two blocks however frequent the key is.
    """
    reach = 2 * span
    rows = links.where("side > 0").select("key", F.explode(F.filter(F.array(
        *[F.when(F.col("side").bitwiseAND(bit) != 0, F.struct(F.col(x).alias("th"), *[F.col(x + f).alias(f) for f in ("l", "c", "r")]))
          for bit, x in ((1, "a"), (2, "b"))]), lambda w: w.isNotNull())).alias("w")).select("key", "w.*")
    spans = (parts.select(F.col("a").alias("th"), F.col("al").alias("start"), F.col("ar").alias("stop")).unionByName(
        parts.select(F.col("b").alias("th"), F.col("bl").alias("start"), F.col("br").alias("stop"))))
    held = spans.groupBy("th").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    roots = connected_components(parts.select("a", "b").distinct()).withColumnRenamed("node", "th")
    inside = F.exists("spans", lambda s: (F.col("c") >= s["start"]) & (F.col("c") < s["stop"]))
    rows = materialise(rows.join(held.join(roots, "th"), "th", "left").select(
        "key", "th", F.greatest("l", F.col("c") - reach).alias("l"), "c", F.least("r", F.col("c") + reach).alias("r"), F.coalesce("root", "th").alias("root"), (~F.coalesce(inside, F.lit(False))).cast("int").alias("open")),
        "passage-rows", compression="zstd")
    # overlapping windows of a text count once
    of_key = rows.groupBy("key", "th").agg(
        F.max("open").alias("open"), F.first("root").alias("root"),
        F.least(F.max("r") - F.min("l") + 1, F.sum((F.col("r") - F.col("l") + 1).cast("long"))).alias("size"))
    apart = (of_key.groupBy("key").agg(F.max("open").alias("open"), F.min("root").alias("low"), F.max("root").alias("high"),
                                       F.min("th").alias("least"), F.max("th").alias("most"), F.sum("size").alias("size"))
             .where("least <> most and (open = 1 or low <> high)")
             .select("key", F.ceil(F.col("size") / F.lit(block)).cast("int").alias("blocks")))
    of_text = (rows.join(apart, "key").groupBy("th").agg(
        F.first("root").alias("root"), F.collect_list(F.struct("key", "blocks", "l", "c", "r", "open")).alias("rows")))
    windows = (single.dropDuplicates(["th"]).join(of_text, "th").select("th", "root", "text", "rows")
               .mapInArrow(_contents(block), "key long, blocks int, th long, root long, open int, l int, c int, content binary"))
    mine = F.pmod(F.xxhash64("th", "key"), F.col("blocks")).cast("int")
    windows = windows.withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    windows = windows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block",
                             "th", "root", "open", "l", "c", "content")
    return materialise(windows.repartition(partitions_of(links), "key", "low", "high").sortWithinPartitions("key", "low", "high")
                       .mapInArrow(_all_pairs(span, similarity),
                                   "a long, b long, al int, ar int, bl int, br int, jaccard double"), "passage-more")


def _joined(windows: DataFrame, partitions: int) -> DataFrame:
    return (windows.repartition(partitions, "key", "salt").sortWithinPartitions("key", "salt", "th", "l")
            .select("key", "salt", "fn", "th", "l", "c", "r").mapInArrow(_join_windows(), _LINK))


def _merged(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a text as one."""
    before = Window.partitionBy("th").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("th").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(F.col("start") > F.coalesce(F.max("stop").over(before), F.lit(-1)), 1).otherwise(0)
    return (spans.withColumn("opens", opens).withColumn("island", F.sum("opens").over(upto))
            .groupBy("th", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island"))


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'int'}" for f in schema)
