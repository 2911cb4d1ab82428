"""SimHash near-duplicates: a binary-trie self-join over 64-bit fingerprints.

Fingerprints within ``budget`` differing bits are linked; the components of
those links are the groups.  By the pigeonhole principle two such fingerprints
agree on at least one of ``budget + 1`` equal blocks, so the trie is dealt to
tasks by (block number, block value): each bucket holds the part of the trie,
rotated to start with that block, below one common prefix.  Inside a bucket
node pairs are traversed together, level by level: children pairs carry the
differing bits gathered so far and are dropped once these exceed the budget.
A bucket too large for one task is dealt again by a block of its remaining
bits (the same argument holds for them), however often that takes.

Only a spanning forest of each bucket's links leaves the task, so a dense
group does not cost its square in rows; components are then found by
star contraction on the distinct fingerprints.

Defined cases: null text reads as empty; a text without words has fingerprint
zero; repeated rows share a fingerprint and so a group; a null id never names
a group and a group of null ids only has a null component.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions_of, texts
from .components import connected_components

BITS = 64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str, length: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; fewer words than ``length`` give one shingle."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_FOLD))
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < length:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(length))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in shingles), np.uint64)


def simhash(text: str, length: int = 3) -> int:
    """The 64 majority bits, as a signed integer."""
    hashes = shingle_hashes(text, length)
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at:at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    value = int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")
    return value - (1 << BITS) if value >> (BITS - 1) else value


def with_simhash(docs: DataFrame, text: str = "text", length: int = 3, to: str = "_fp") -> DataFrame:
    """``docs`` with the fingerprint (signed long) of every whole text."""
    udf = F.arrow_udf(lambda t: pa.array([simhash(x, length) for x in texts(t)], pa.int64()), "long")
    return docs.withColumn(to, udf(F.col(text).cast("string")))


def trie_links(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, shared: int, budget: int,
               frontier: int = 500_000):
    """Linked index pairs of sorted distinct keys, by traversing node pairs of the implied trie.

    ``values`` are uint64 keys, sorted within each bucket [starts, ends), whose
    first ``shared`` bits agree there.  A node is a range of keys with the same
    first bits.  Yields arrays (i, j).  The frontier is a stack of slices of
    at most ``frontier`` node pairs, so memory stays bounded.
    """
    stack = [(shared, starts, ends, starts, ends, np.zeros(len(starts), np.int8))]
    while stack:
        depth, lo, hi, lo2, hi2, used = stack.pop()
        single = (hi - lo == 1) & (hi2 - lo2 == 1)
        if single.any():                       # two leaves: their last bits in one step
            i, j = lo[single], lo2[single]
            i, j = i[i != j], j[i != j]
            rest = values[i] ^ values[j]
            near = np.bitwise_count(rest) <= budget
            if near.any():
                yield i[near], j[near]
            keep = ~single
            lo, hi, lo2, hi2, used = lo[keep], hi[keep], lo2[keep], hi2[keep], used[keep]
        if not len(lo):
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        mid, mid2 = _split(values, lo, hi, bit), _split(values, lo2, hi2, bit)
        same = lo == lo2
        parts = []
        for a, b, c, d, cost, which in ((lo, mid, lo2, mid2, 0, None), (mid, hi, mid2, hi2, 0, None),
                                        (lo, mid, mid2, hi2, 1, None), (mid, hi, lo2, mid2, 1, ~same)):
            ok = (b > a) & (d > c) & (used + cost <= budget)
            if which is not None:              # a node paired with itself crosses once
                ok &= which
            ok &= ~((a == c) & (b - a == 1))   # a leaf with itself links nothing
            if ok.any():
                parts.append((a[ok], b[ok], c[ok], d[ok], used[ok] + np.int8(cost)))
        if not parts:
            continue
        joined = [np.concatenate(x) for x in zip(*parts)]
        for at in range(0, len(joined[0]), frontier):
            stack.append((depth + 1, *(x[at:at + frontier] for x in joined)))


def _split(values, lo, hi, bit):
    """First position in each range whose key has ``bit`` set; keys share all bits above it."""
    first = values[lo]
    target = (first & ~(bit - np.uint64(1))) | bit
    a, b = lo.copy(), hi.copy()
    while True:                                # a binary search for all ranges at once
        open_ = a < b
        if not open_.any():
            return a
        m = (a + b) >> 1
        less = np.zeros(len(a), bool)
        less[open_] = values[m[open_]] < target[open_]
        a = np.where(open_ & less, m + 1, a)
        b = np.where(open_ & ~less, m, b)


def joined_roots(n: int, links) -> np.ndarray:
    """Smallest index each of ``n`` indexes reaches over the link arrays, taken in turn."""
    root = np.arange(n)
    for i, j in links:
        while True:
            x, y = root[i], root[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _bucket_stars(shared: int, budget: int):
    """Task: rows (path, key, fp) sorted by path and key; each bucket's members and the member they join to."""
    def stars(path, key, fp):
        prefix = key >> np.uint64(BITS - shared)
        starts = np.concatenate([[0], np.flatnonzero((np.diff(path) != 0) | (np.diff(prefix) != 0)) + 1])
        ends = np.concatenate([starts[1:], [len(key)]])
        shown = ends - starts > 1
        root = joined_roots(len(key), trie_links(key, starts[shown], ends[shown], shared, budget))
        moved = np.flatnonzero(root != np.arange(len(key)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], ["a", "b"])

    def run(batches):
        held = None                            # rows of the bucket that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column(0).to_numpy()
            key = batch.column(1).to_numpy().view(np.uint64)
            fp = batch.column(2).to_numpy()
            if held:
                path, key, fp = (np.concatenate(x) for x in zip(held, (path, key, fp)))
            prefix = key >> np.uint64(BITS - shared)
            other = np.flatnonzero((path != path[-1]) | (prefix != prefix[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield stars(path[:cut], key[:cut], fp[:cut])
            held = path[cut:], key[cut:], fp[cut:]
        if held:
            yield stars(*held)
    return run


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _dealt(rows: DataFrame, shared: int, budget: int) -> DataFrame:
    """Each (path, key, fp) once per block of the bits after the ``shared`` ones, that block moved to their front."""
    rest = BITS - shared
    at = [rest * k // (budget + 1) for k in range(budget + 2)]
    right = F.shiftrightunsigned

    def low(c, bits):
        return c.bitwiseAND(F.lit(_signed((1 << bits) - 1)).cast("long"))

    def moved(o, s):
        key, after = F.col("key"), rest - o - s
        tail = low(key, rest)
        block = low(right(tail, after) if after else tail, s)
        before = low(right(tail, rest - o), o) if o else F.lit(0).cast("long")
        head = key.bitwiseAND(F.lit(_signed((1 << BITS) - (1 << rest))).cast("long")) if shared else F.lit(0).cast("long")
        return (head.bitwiseOR(F.shiftleft(block, rest - s)).bitwiseOR(F.shiftleft(before, after))
                .bitwiseOR(low(tail, after) if after else F.lit(0).cast("long")))

    options = [F.struct((F.col("path") * (budget + 1) + k).alias("path"), moved(at[k], at[k + 1] - at[k]).alias("key"),
                        F.col("fp").alias("fp")) for k in range(budget + 1)]
    return rows.select(F.explode(F.array(*options)).alias("r")).select("r.*")


def fingerprint_links(distinct: DataFrame, budget: int = 3, bucket_rows: int = 50_000) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints ``fp`` within ``budget`` bits, transitively.

    ``bucket_rows`` says only when a bucket is dealt again by more bits; no link is lost by it.
    """
    rows = distinct.select(F.lit(0).cast("long").alias("path"), F.col("fp").alias("key"), F.col("fp"))
    shared, out = 0, None
    while True:
        rows = _dealt(rows, shared, budget)
        shared += (BITS - shared) // (budget + 1)
        bucket = F.shiftrightunsigned("key", BITS - shared)
        rows = rows.withColumn("bucket", bucket)
        last = (BITS - shared) // (budget + 1) == 0
        large = None
        if not last:
            large = materialise(rows.groupBy("path", "bucket").count().where(F.col("count") > bucket_rows)
                                .select("path", "bucket"), "trie-large")
            if large.isEmpty():
                large = None
        whole = rows.join(large, ["path", "bucket"], "left_anti") if large is not None else rows
        links = (whole.repartition(partitions_of(rows), "path", "bucket").sortWithinPartitions("path", "key")
                 .select("path", "key", "fp").mapInArrow(_bucket_stars(shared, budget), "a long, b long"))
        out = links if out is None else out.unionByName(links)
        if large is None:
            return out
        rows = materialise(rows.join(large, ["path", "bucket"], "left_semi").select("path", "key", "fp"), "trie-rows")


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 3,
                       budget: int = 3) -> DataFrame:
    """Per document: doc_id, fp (signed long), component_id (smallest id reachable over links).

    The fingerprints are written once to the shared folder and read for every later step.
    """
    marks = materialise(with_simhash(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
                                     length=length, to="fp").select("doc_id", "fp"), "simhash")
    ids = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = connected_components(fingerprint_links(ids, budget))
    named = ids.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    per_fp = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marks.join(per_fp, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp):
    """16 lower-case hex digits of a signed fingerprint column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 3,
               budget: int = 3) -> DataFrame:
    """``docs`` without the documents whose id is not the smallest of its component.

    Rows repeating one id are one document and stay or go together; rows with a
    null id stay.  Only the ids to drop are joined to the documents.
    """
    groups = simhash_components(docs, text, doc_id, length, budget)
    drop = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_drop")).distinct()
    return docs.join(drop, docs[doc_id] == drop["_drop"], "left_anti")
