"""Document fingerprints from prefix polynomial hashes.

A text's code points c_0, c_1, ... give two modular prefix arrays
S[i] = sum of c_j * B^j for j < i, modulo 2^31 - 1.  A span's hash, shifted back by a
power of 1/B, does not depend on where it stands, so any two spans compare in constant
time and a longest common extension is a binary search over its length.

A fingerprint holds the number of code points, the hash of the whole text and the
``keep`` smallest (mixed) hashes of all spans of ``width`` code points.  The likeness of
two fingerprints is the share of common spans among the smallest of both
together, an estimate of the Jaccard similarity of their span sets.

Defined cases: null text reads as empty; a text shorter than a span is one span;
two empty texts have likeness 1, an empty and another one 0; the next document goes by
ascending id (nulls first, equal ids by their text's hash), after the last comes the first,
and a single document is followed by itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import all_chunks, materialise, partitions_of

P = (1 << 31) - 1
BASES = (1_000_003 * 911 % P, 998_244_353 % P)
_INVERSES = tuple(pow(b, P - 2, P) for b in BASES)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for uint64 values below 2^62."""
    x = (x & np.uint64(P)) + (x >> np.uint64(31))
    x = (x & np.uint64(P)) + (x >> np.uint64(31))
    return np.where(x >= P, x - np.uint64(P), x)


class Powers:
    """Powers of the bases and of their inverses, grown by doubling."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64) for _ in BASES]
        self.down = [np.ones(1, np.uint64) for _ in BASES]

    def reach(self, n: int):
        while len(self.up[0]) < n:
            have = len(self.up[0])
            for k, (b, inverse) in enumerate(zip(BASES, _INVERSES)):
                self.up[k] = np.concatenate([self.up[k], _mod(self.up[k] * np.uint64(pow(b, have, P)))])
                self.down[k] = np.concatenate([self.down[k], _mod(self.down[k] * np.uint64(pow(inverse, have, P)))])


POWERS = Powers()


def points_of(text: str) -> np.ndarray:
    """Code points plus one, so that a zero counts too."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, points: np.ndarray, head: "PrefixHash | None" = None, kept: int = 0):
        """``head``: another text's arrays whose first ``kept`` points this one shares."""
        self.n = len(points)
        POWERS.reach(self.n + 1)
        self.sums = []
        for k in range(len(BASES)):
            new = np.cumsum(_mod(points[kept:] * POWERS.up[k][kept:self.n]))
            first = head.sums[k][:kept + 1] if head else np.zeros(1, np.uint64)
            self.sums.append(np.concatenate([first, _mod(new + first[-1])]))

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [start, stop); equal spans have equal hashes wherever they stand."""
        parts = [_mod(_mod(s[stop] + np.uint64(P) - s[start]) * d[start]) for s, d in zip(self.sums, POWERS.down)]
        return parts[0] << np.uint64(31) | parts[1]

    def span(self, start: int, stop: int) -> int:
        return int(self.hashes(np.array([start]), np.array([stop]))[0])

    def extension(self, i: int, other: "PrefixHash", j: int) -> int:
        """Length of the longest common extension from ``i`` here and ``j`` there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                low = mid
            else:
                high = mid - 1
        return low

    def spans(self, width: int, since: int = 0) -> np.ndarray:
        """Hashes of all spans of ``width`` starting at ``since`` or later; one of the whole text if it is shorter."""
        if self.n <= width:
            return self.hashes(np.zeros(1, np.int64), np.array([self.n])) if since == 0 else np.zeros(0, np.uint64)
        out = []
        for s, d in zip(self.sums, POWERS.down):
            a = s[since:self.n - width + 1]
            out.append(_mod(_mod(s[since + width:] + np.uint64(P) - a) * d[since:self.n - width + 1]))
        return out[0] << np.uint64(31) | out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    """A multiplicative mix to 32 bits, so that small values are a fair sample."""
    h = (h ^ h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)


def _least(values: np.ndarray, keep: int) -> np.ndarray:
    if len(values) > 4 * keep:
        # enough smallest ones that repeats do not leave too few
        at = 4 * keep
        least = np.unique(np.partition(values, at)[:at + 1])
        if len(least) >= keep:
            return least[:keep]
    return np.unique(values)[:keep]


class Fingerprint:
    """n code points, the whole text's hash and the smallest span hashes."""

    def __init__(self, prefix: PrefixHash, least: np.ndarray):
        self.n, self.whole, self.least = prefix.n, prefix.span(0, prefix.n), least

    def __str__(self) -> str:
        return f"{self.n:x}:{self.whole:016x}:" + self.least.astype(">u4").tobytes().hex()


def likeness(a: Fingerprint, b: Fingerprint, keep: int) -> float:
    if a.n == b.n and a.whole == b.whole:
        return 1.0
    if not a.n or not b.n:
        return 0.0
    both = np.union1d(a.least, b.least)[:keep]
    return float((np.isin(both, a.least) & np.isin(both, b.least)).mean())


class Text:
    """A text with its prefix arrays and fingerprint."""

    def __init__(self, text: str, width: int, keep: int):
        self.text, self.points = text, points_of(text)
        self.prefix = PrefixHash(self.points)
        self.spans = _mixed(self.prefix.spans(width))
        self.print = Fingerprint(self.prefix, _least(self.spans, keep))

    def edited(self, following: "Text", width: int, keep: int) -> tuple[str, Fingerprint]:
        """The last quarter replaced by as much of the next text; the shared head's arrays are used again."""
        quarter = len(self.points) // 4
        kept = len(self.points) - quarter
        new = self.text[:kept] + following.text[:quarter]
        prefix = PrefixHash(np.concatenate([self.points[:kept], following.points[:quarter]]), self.prefix, kept)
        if kept >= width and prefix.n > width:
            shared = kept - width + 1
            spans = np.concatenate([self.spans[:shared], _mixed(prefix.spans(width, shared))])
        else:
            spans = _mixed(prefix.spans(width))
        return new, Fingerprint(prefix, _least(spans, keep))


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")
_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                  ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                  ("near_next", pa.float64())])


def _row(doc, own: Text, following: Text, width: int, keep: int) -> tuple:
    new, fingerprint = own.edited(following, width, keep)
    return (doc, len(own.points), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), str(own.print),
            str(fingerprint), likeness(own.print, fingerprint, keep), likeness(own.print, following.print, keep))


def _compare(width: int, keep: int):
    def run(batches):
        """Rows in order of bucket and id; a bucket's last row is the first one of the bucket after it."""
        held = None                            # (bucket, doc_id, Text) still waiting for its next document
        for batch in all_chunks(batches, "text"):
            rows = []
            for bucket, doc, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text"))):
                own = Text(text or "", width, keep)
                if held is not None and held[0] == bucket:
                    rows.append(_row(held[1], held[2], own, width, keep))
                held = bucket, doc, own
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)] if rows else
                                             [pa.array([], f.type) for f in _OUT], schema=_OUT)
    return run


def edited_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 16,
                        keep: int = 64, most_buckets: int = 8192) -> DataFrame:
    """Per document: its fingerprint, its edited text's, and their likeness to each other and the next document's.

    Documents are dealt once, by ranges of their id.  Each range also gets a copy
    of the first row of the next range, which ends it; those rows number at
    most ``most_buckets``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = min(most_buckets, 4 * partitions_of(docs))
    found = rows.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)
    edges = [-float("inf"), *sorted(set(found) or {0.0}), float("inf")]
    dealt = Bucketizer(splits=edges, inputCol="_id", outputCol="_bucket", handleInvalid="keep").transform(
        rows.withColumn("_id", F.col("doc_id").cast("double")))
    # Bucketizer puts nulls into a last bucket of their own; they come first here
    dealt = (dealt.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_bucket").cast("int")))
             .drop("_id", "_bucket").withColumn("tie", F.xxhash64("text")))
    heads = materialise(dealt.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id"), F.col("tie"))).alias("h"))
                        .select("bucket", "h.*"), "fingerprint-heads")
    order = sorted(r["bucket"] for r in heads.select("bucket").collect())
    before = spark.createDataFrame([(b, order[i - 1]) for i, b in enumerate(order)], "bucket int, ends int")
    first = heads.join(F.broadcast(before), "bucket").select(
        "ends", "bucket", F.col("doc_id").alias("h_id"), F.col("tie").alias("h_tie"))
    ends = (dealt.join(F.broadcast(first), (dealt["bucket"] == first["bucket"]) & dealt["doc_id"].eqNullSafe(first["h_id"])
                       & (dealt["tie"] == first["h_tie"])).select(F.col("ends").alias("bucket"), F.lit(1).alias("last"),
                                                                 "doc_id", "tie", "text")
            .dropDuplicates(["bucket"]))
    whole = dealt.select("bucket", F.lit(0).alias("last"), "doc_id", "tie", "text").unionByName(ends)
    return (whole.repartition(partitions_of(docs), "bucket")
            .sortWithinPartitions("bucket", "last", F.col("doc_id").asc_nulls_first(), "tie")
            .select("bucket", "doc_id", "text").mapInArrow(_compare(width, keep), OUT))
