"""Lexical retrieval packing: a sharded BM25 index over token ids fills each window with its seed's neighbours.

Every document becomes its tokenizer's ids and an end id.  Whole windows of a
long document are sequences of their own; the rest of each document is packed.
Document frequencies are counted over all documents; the rests are
range-partitioned by their most telling token (frequent there, late in the vocabulary) and by two tokens drawn by
min-hash, so alike ones are near whatever token they share with very many, and each task takes them
in shards.  A shard has an inverted index (token -> documents with BM25 weights).  A window starts with a seed, is filled with the seed's
best-scoring unused neighbours, and the one that overflows is cut: what is left of it
is the next seed.  The window open at the end of a shard goes on in the next;
the one open at the end of a task is cut into powers of two, so nothing is padded.

Defined cases: null or empty texts are one end id; repeated rows are packed
each on its own; a null id is carried along; an empty table gives no rows;
equal scores go to the document that comes first by its ordering tokens and content.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import all_chunks, materialise

WINDOW = 4096
END = 2
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECE = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


#: Multipliers of the two word hashes, odd and so invertible modulo 2^64.
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_LETTER = np.zeros(256, bool)
_LETTER[ord("a"):ord("z") + 1] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,")] = True
#: Bytes hashed at a time.
BLOCK = 4_000_000


class _Powers:
    """Powers of the hash bases and of their inverses, grown by doubling."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64) for _ in _BASES]
        self.down = [np.ones(1, np.uint64) for _ in _BASES]

    def reach(self, n: int):
        while len(self.up[0]) < n:
            have = len(self.up[0])
            for k, base in enumerate(_BASES):
                inverse = pow(base, -1, 1 << 64)
                self.up[k] = np.concatenate([self.up[k], self.up[k] * np.uint64(pow(base, have, 1 << 64))])
                self.down[k] = np.concatenate([self.down[k], self.down[k] * np.uint64(pow(inverse, have, 1 << 64))])


_POWERS = _Powers()


def spans_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts of lower-cased bytes whose ids, one after the other, are the text's ids.

    No alternative of the tokenizer's pattern, none of its added tokens and no
    canonical composition crosses ASCII white space.  ASCII letters are
    lower-cased by the tokenizer anyway, and a single full stop or comma between a
    letter and white space is a part of its own to it, which leaves fewer different words.
    """
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = _SPACE[raw]
    mark = np.zeros(len(raw) + 1, bool)
    mark[1:-1] = _MARK[raw[1:]] & _LETTER[raw[:-1]] & blank[3:]
    starts = ~blank[1:-1] & (blank[:-2] | mark[:-1])
    ends = ~blank[1:-1] & (blank[2:] | mark[1:])
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit polynomial hashes of each span, from prefix sums modulo 2^64."""
    _POWERS.reach(len(raw) + 1)
    wide, out = raw.astype(np.uint64) + np.uint64(1), []
    for up, down in zip(_POWERS.up, _POWERS.down):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(wide * up[:len(raw)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        out.append((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9))
    return out


class WordIds:
    """Ids of texts through a store of the ids of their words, of ``most`` words and those of one block at most.

    A word is known by one hash and checked by the other; where a check fails, its text is tokenized whole.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.ids = np.zeros(0, np.uint32)
        self.known = self.check = np.zeros(0, np.uint64)           # hashes in order, and the second ones
        self.place = np.zeros(0, np.int64)                         # of the sorted hashes in the arrays below
        self.begin = self.size = self.used = np.zeros(0, np.int64)

    def _forget(self):
        """Keep the words used again since they came in, and half of the store at most."""
        order = np.argsort(-self.used, kind="stable")[:self.most // 2]
        keep = np.sort(order[self.used[order] > 1])
        number = np.full(len(self.used), -1, np.int64)
        number[keep] = np.arange(len(keep))
        place = number[self.place]
        stay = place >= 0
        self.known, self.check, self.place = self.known[stay], self.check[stay], place[stay]
        self.ids, self.size = self._ids(keep), self.size[keep]
        self.begin = np.cumsum(self.size) - self.size
        self.used = np.zeros(len(keep), np.int64)

    def _learn(self, words: list[bytes], known: np.ndarray, check: np.ndarray):
        """Tokenize fresh words and put their hashes among the known ones."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words],
                                                                 add_special_tokens=False)]
        place = np.arange(len(self.size), len(self.size) + len(lists))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), np.uint32)])
        self.size = np.concatenate([self.size, np.fromiter(map(len, lists), np.int64, len(lists))])
        self.begin = np.cumsum(self.size) - self.size
        self.used = np.concatenate([self.used, np.zeros(len(lists), np.int64)])
        at = np.searchsorted(self.known, known)
        self.known, self.check = np.insert(self.known, at, known), np.insert(self.check, at, check)
        self.place = np.insert(self.place, at, place)

    def _ids(self, at: np.ndarray) -> np.ndarray:
        size = self.size[at]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.begin[at] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def _places(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each word of a block, its start, and whether the second hash agrees."""
        data = np.frombuffer(raw, np.uint8)
        starts, ends = spans_of(data)
        h, check = word_hashes(data, starts, ends)
        order = np.argsort(h)
        ranked = h[order]
        new = np.ones(len(h), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        own, first = ranked[new], order[new]
        at = np.searchsorted(self.known, own)
        fresh = np.ones(len(own), bool)
        inside = at < len(self.known)
        fresh[inside] = self.known[at[inside]] != own[inside]
        if fresh.any():
            bounds = zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist())
            self._learn([raw[a:b] for a, b in bounds], own[fresh], check[first[fresh]])
            at = np.searchsorted(self.known, own)
        word = np.empty(len(h), np.int64)
        word[order] = at[np.cumsum(new) - 1]
        places = self.place[word]
        self.used += np.bincount(places, minlength=len(self.used))
        return places, starts, self.check[word] == check

    def encode(self, values: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, without the end id."""
        out: list[np.ndarray | None] = [None] * len(values)
        block, held = [], 0
        for i, v in enumerate(values):
            raw = (v or "").encode("utf-8", "surrogatepass")
            if b"<|" in raw:                                       # could hold an added token
                out[i] = self._whole(v)
                continue
            block.append((i, raw.lower()))
            held += len(raw) + 1
            if held >= BLOCK:
                self._block(block, values, out)
                block, held = [], 0
        self._block(block, values, out)
        return out

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _block(self, block: list[tuple[int, bytes]], values: list, out: list):
        """Ids of the texts of one block; a text longer than a block is taken in parts cut at white space."""
        if not block:
            return
        if len(self.known) > self.most:
            self._forget()
        if len(block) == 1 and len(block[0][1]) > 2 * BLOCK:
            i, raw = block[0]
            parts, at = [], 0
            while at < len(raw):
                cut = re.compile(rb"[ \t\n\r\x0b\x0c]").search(raw, min(at + BLOCK, len(raw)))
                end = cut.end() if cut else len(raw)
                places, _, same = self._places(raw[at:end])
                parts.append(self._ids(places))
                if not same.all():
                    out[i] = self._whole(values[i])
                    return
                at = end
            out[i] = np.concatenate(parts)
            return
        places, starts, same = self._places(b" ".join(raw for _, raw in block))
        sizes = np.array([len(raw) + 1 for _, raw in block])
        words = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))      # first word of each text
        tokens = np.concatenate([[0], np.cumsum(self.size[places])])[words]
        ids = self._ids(places)
        wrong = np.flatnonzero(~same)
        spoilt = set((np.searchsorted(words, wrong, side="right") - 1).tolist())
        for k, (i, _) in enumerate(block):
            out[i] = self._whole(values[i]) if k in spoilt else ids[tokens[k]:tokens[k + 1]]


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The store of this Python worker, kept from task to task."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


#: Tokens that order the rests: the most telling one, and two drawn by min-hash.
DRAWS = (0x9E3779B1, 0x85EBCA6B)


def _documents(ids: list[np.ndarray], vocabulary: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the documents holding each token; each document's most telling token and its min-hash tokens.

    Two documents draw the same token as often as their token sets are alike, whatever tokens all documents share.
    """
    sizes = np.array([len(x) for x in ids])
    key, count = np.unique(np.repeat(np.arange(len(ids)), sizes) * vocabulary + np.concatenate(ids), return_counts=True)
    doc, token = key // vocabulary, key % vocabulary
    first = np.searchsorted(doc, np.arange(len(ids)))
    score = count * weight[token]
    best = np.flatnonzero(score == np.maximum.reduceat(score, first)[doc])
    out = [token[best[np.searchsorted(doc[best], np.arange(len(ids)))]]]
    for odd in DRAWS:
        mixed = token.astype(np.uint64) * np.uint64(odd) & np.uint64(0xFFFFFFFF)
        mixed = (mixed ^ mixed >> np.uint64(15)) * np.uint64(0x2C1B3C6D) & np.uint64(0xFFFFFFFF)
        least = np.minimum.reduceat(mixed << np.uint64(32) | token.astype(np.uint64), first)
        out.append((least & np.uint64(0xFFFFFFFF)).astype(np.int64))
    return np.bincount(token, minlength=vocabulary), np.stack(out, axis=1).astype(np.int32)


def _tokenize(path: str):
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                        ("offset", pa.int64()), ("ids", pa.binary()), ("telling", pa.list_(pa.int32())),
                        ("tokens", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def run(batches):
        """kind 0: a whole window; 1: a document's rest, with the ids that order it; 2: this task's document counts."""
        words, task, made = word_ids(path), TaskContext.get().partitionId(), 0
        vocabulary = words.tokenizer.get_vocab_size()
        seen = np.zeros(vocabulary, np.int64)
        weight = np.log1p(np.arange(vocabulary))     # ids are in the order of merges, common ones first
        for batch in all_chunks(batches, "text"):
            rows = []
            every = [np.append(ids, np.uint32(END)) for ids in words.encode(batch.column("text").to_pylist())]
            held, telling = _documents(every, vocabulary, weight)
            seen += held
            for doc, ids, own in zip(batch.column("doc_id").to_pylist(), every, telling.tolist()):
                n = len(ids)
                for at in range(0, n - WINDOW + 1, WINDOW):
                    sequence = (1 << 62) | (task << 36) | made
                    rows.append((0, doc, at, WINDOW, _crc(ids[at:at + WINDOW]), n, sequence, 0, None, None, None, None))
                    made += 1
                rest = n // WINDOW * WINDOW
                if rest < n:
                    rows.append((1, doc, rest, n - rest, None, n, None, None, ids[rest:].astype("<u4").tobytes(),
                                 own, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        own = np.flatnonzero(seen)
        if len(own):
            last = (2, None, None, None, None, None, None, None, None, None, own.tolist(), seen[own].tolist())
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(last, schema)], schema=schema)
    return run


_TOKENIZED = ("kind int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long, ids binary, telling array<int>, tokens array<int>, counts array<long>")


class Shard:
    """A BM25 inverted index over the rests of one shard."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, average: float, k1: float = 1.2, b: float = 0.75):
        n = len(ids)
        sizes = np.array([len(x) for x in ids], np.int64)
        doc = np.repeat(np.arange(n, dtype=np.int64), sizes)
        key, tf = np.unique(doc * len(idf) + np.concatenate(ids), return_counts=True)
        self.doc, term = key // len(idf), key % len(idf)
        norm = k1 * (1 - b + b * sizes / max(average, 1.0))
        weight = idf[term] * tf * (k1 + 1) / (tf + norm[self.doc])
        self.first = np.searchsorted(self.doc, np.arange(n + 1))
        self.term = term
        order = np.argsort(term, kind="stable")
        self.posting, self.weight = self.doc[order], weight[order]
        present, begin = np.unique(term[order], return_index=True)
        self.begin = np.append(begin, len(order))
        self.place = np.full(len(idf), -1, np.int64)
        self.place[present] = np.arange(len(present))
        self.n = n

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 score of every document of the shard for a set of tokens."""
        at = self.place[terms]
        at = at[at >= 0]
        size = self.begin[at + 1] - self.begin[at]
        ends = np.cumsum(size)
        where = np.repeat(self.begin[at] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return np.bincount(self.posting[where], self.weight[where], self.n)

    def terms(self, i: int) -> np.ndarray:
        return self.term[self.first[i]:self.first[i + 1]]


class Packer:
    """Fills windows from shard after shard; ``pieces`` holds what is finished."""

    def __init__(self, idf: np.ndarray, average: float, task: int):
        self.idf, self.average, self.task, self.made = idf, average, task, 0
        self.window: list[tuple] = []          # (doc_id, start, ids, doc_tokens)
        self.room = WINDOW
        self.pieces: list[tuple] = []

    def _close(self, parts: list[tuple]):
        at, sequence = 0, (self.task << 36) | self.made
        for doc, start, ids, total in parts:
            self.pieces.append((doc, start, len(ids), _crc(ids), total, sequence, at))
            at += len(ids)
        self.made += 1

    def _put(self, doc, start, ids, total):
        """Put what fits into the open window; the rest, or None."""
        take = min(self.room, len(ids))
        self.window.append((doc, start, ids[:take], total))
        self.room -= take
        if not self.room:
            self._close(self.window)
            self.window, self.room = [], WINDOW
        return (doc, start + take, ids[take:], total) if take < len(ids) else None

    def add(self, docs: list[tuple]):
        """Pack a shard of (doc_id, start, ids, doc_tokens)."""
        index = Shard([d[2] for d in docs], self.idf, self.average)
        unused = np.ones(len(docs), bool)
        queue = deque(range(len(docs)))
        query = np.unique(self.window[-1][2]) if self.window else None
        while True:
            if query is None:
                while queue and not unused[queue[0]]:
                    queue.popleft()
                if not queue:
                    return
                seed = queue.popleft()
                unused[seed] = False
                query, rest = index.terms(seed), self._put(*docs[seed])
                if rest is not None or not self.window:      # cannot be cut: a rest is shorter than a window
                    query = None
                    continue
            near = index.scores(query)
            for i in np.argsort(-np.where(unused, near, -np.inf), kind="stable"):
                if not unused[i]:
                    return                                   # nothing left: the window stays open
                unused[i] = False
                rest = self._put(*docs[i])
                if rest is not None:                         # it was cut: what is left seeds the next window
                    query = index.terms(i)
                    self._put(*rest)
                    break
                if not self.window:
                    query = None
                    break
            else:
                return

    def finish(self):
        """Cut the open window into sequences whose lengths are powers of two."""
        parts = deque(self.window)
        left = WINDOW - self.room
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            taken = []
            while size:
                doc, start, ids, total = parts.popleft()
                if len(ids) > size:
                    parts.appendleft((doc, start + size, ids[size:], total))
                    ids = ids[:size]
                taken.append((doc, start, ids, total))
                size -= len(ids)
            self._close(taken)
        self.window, self.room = [], WINDOW


def _pack(shared, average: float, shard_docs: int):
    def out(packer):
        columns = list(zip(*packer.pieces)) or [[] for _ in _PIECE]
        packer.pieces = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_PIECE)

    def run(batches):
        packer, shard = Packer(shared.value, average, TaskContext.get().partitionId()), []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))):
                shard.append((row[0], row[1], np.frombuffer(row[2], "<u4"), row[3]))
                if len(shard) == shard_docs:
                    packer.add(shard)
                    shard = []
                    yield out(packer)
        if shard:
            packer.add(shard)
        packer.finish()
        yield out(packer)
    return run


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", shard_docs: int = 512,
         task_tokens: int = 8_000_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` names a file every executor can read.  What is broadcast is
    one weight per vocabulary entry.  A task holds one shard of at most
    ``shard_docs`` rests, each shorter than a window.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    table = materialise(narrow.mapInArrow(_tokenize(tokenizer), _TOKENIZED), "tokens", compression="zstd")
    rests = table.where("kind = 1")
    sums = rests.agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).first()
    n, tokens = sums["n"], sums["tokens"] or 0
    whole = table.where("kind = 0").select(*_PIECE.names)
    if not n:
        return whole
    seen = (table.where("kind = 2").select(F.explode(F.arrays_zip("tokens", "counts")).alias("x"))
            .groupBy(F.col("x.tokens").alias("token")).agg(F.sum("x.counts").alias("docs")).collect())
    idf = np.zeros(max((r["token"] for r in seen), default=0) + 1)
    for r in seen:
        idf[r["token"]] = np.log(1 + (max(n, r["docs"]) - r["docs"] + 0.5) / (r["docs"] + 0.5))
    shared = spark.sparkContext.broadcast(idf)

    # by content alone: equal texts adjoin, alike ones share their telling token and most likely the drawn ones
    order = ["telling", "_content", "doc_id", "start"]
    dealt = (rests.withColumn("_content", F.xxhash64("ids")).select(*order, "ids", "doc_tokens")
             .repartitionByRange(int(tokens // task_tokens) + 1, *order).sortWithinPartitions(*order))
    packed = dealt.select("doc_id", "start", "ids", "doc_tokens").mapInArrow(_pack(shared, tokens / n, shard_docs), PIECE)
    return whole.unionByName(packed)
