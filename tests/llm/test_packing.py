import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from scoreforge.llm import packing

from .conftest import ODD, SF001

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD_TEXTS = ["a\x1cb c", "<|endoftext|>x <|startoftext|>", "À ̀b  é x", "日本 語　テ", "﻿a It's we'LL", "ΣΑΣ σ", "İstanbul ß",
             "it's. ok, A.B. x.. y,, n. 3. é. .", "<|STARTOFTEXT|> a", "À b́", "K Å", "x　y. z", "x, y", "'S 'll. ,"]


def ids_of(tokenizer, text):
    return np.append(np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4"), np.uint32(2)).astype("<u4")


def check(rows, docs):
    tokenizer = Tokenizer.from_file(PATH)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for group in sequences.values():
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 4096
        assert at == 4096 or at & (at - 1) == 0          # nothing is padded
    for doc, text in docs:
        ids = ids_of(tokenizer, text)
        own = sorted(pieces[doc], key=lambda r: r["start"])
        covered = 0
        for r in own:
            assert r["start"] == covered and r["doc_tokens"] == len(ids)
            assert zlib.crc32(ids[covered:covered + r["length"]].tobytes()) == r["ids_crc32"]
            covered += r["length"]
        assert covered == len(ids)


def test_words_give_the_tokenizers_ids(spark):
    docs = [r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").select("text").collect()]
    tokenizer = Tokenizer.from_file(PATH)
    words = packing.WordIds(PATH, most=5000)             # small enough to forget words now and then
    for at in range(0, len(docs), 40):
        for text, ids in zip(docs[at:at + 40], words.encode(docs[at:at + 40])):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    for text, ids in zip(ODD_TEXTS, words.encode(ODD_TEXTS)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_every_id_is_packed_once(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    check(packing.pack(docs, PATH, shard_docs=30).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(spark, make_docs):
    rows = [r for i, r in enumerate(ODD) if r not in ODD[:i]]
    check(packing.pack(make_docs(rows), PATH).collect(), rows)
    twice = packing.pack(make_docs(ODD), PATH).collect()
    ids = len(ids_of(Tokenizer.from_file(PATH), "plain words in a row"))
    assert sum(r["length"] for r in twice if r["doc_id"] == 4) == 2 * ids
    assert packing.pack(make_docs([]), PATH).count() == 0


def test_bm25_scores_match_their_definition():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 20, rng.integers(1, 40)).astype(np.uint32) for _ in range(12)]
    idf, average = rng.random(20), 17.0
    query = np.unique(docs[3])
    want = []
    for d in docs:
        total = 0.0
        for t in query:
            tf = (d == t).sum()
            total += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / average)) if tf else 0
        want.append(total)
    assert np.allclose(packing.Shard(docs, idf, average).scores(query), want)


def test_a_seed_is_followed_by_its_nearest_neighbours():
    rng = np.random.default_rng(1)
    topic = [rng.integers(k * 100, k * 100 + 100, 300).astype(np.uint32) for k in (0, 1, 0, 1, 0)]
    packer = packing.Packer(np.ones(200), 300.0, 0)
    packer.add([(k, 0, ids, 300) for k, ids in enumerate(topic)])
    packer.finish()
    order = [p[0] for p in sorted(packer.pieces, key=lambda p: (p[5], p[6]))]
    first = list(dict.fromkeys(order))
    assert set(first[:3]) == {0, 2, 4}


def test_hashes_tell_words_apart_and_failed_checks_are_tokenized_whole(monkeypatch):
    texts = ["one two. three", "two, one", "", "x" * 9, "a  b\tc\nd."] + ODD_TEXTS
    tokenizer = Tokenizer.from_file(PATH)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    plain = packing.word_hashes
    monkeypatch.setattr(packing, "word_hashes", lambda *a: [plain(*a)[0] % np.uint64(5), plain(*a)[1]])   # many collisions
    words = packing.WordIds(PATH)
    for _ in range(2):
        assert [x.tolist() for x in words.encode(texts)] == want
    monkeypatch.setattr(packing, "word_hashes", plain)
    monkeypatch.setattr(packing, "BLOCK", 64)
    long = " ".join(texts[:4] * 40)                       # longer than two blocks: taken in parts
    assert packing.WordIds(PATH).encode([long])[0].tolist() == tokenizer.encode(long, add_special_tokens=False).ids


def test_pairs_meet_although_all_share_a_hot_token(spark):
    """3,000 pairs of equal or nearly equal texts, one frequent token in all: a full index gives each its partner first."""
    rng = np.random.default_rng(5)
    words = np.array(["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(4000)])
    rows = []
    for k in range(3000):
        own = rng.choice(words, 40).tolist()
        near = list(own)
        if k % 2:
            near[int(rng.integers(40))] = str(rng.choice(words))
        for j, text in enumerate((own, near)):
            rows.append((2 * k + j, " ".join(["zyzzyvas"] * 30 + text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    pieces = packing.pack(docs, PATH).collect()
    where, seeds = {}, []
    for r in pieces:
        where.setdefault(r["doc_id"], set()).add(r["sequence_id"])
        seeds += [(r["sequence_id"], r["doc_id"])] if r["offset"] == 0 else []
    equal = np.mean([bool(where[2 * k] & where[2 * k + 1]) for k in range(0, 3000, 2)])
    # a window is filled with its seed's neighbours: the seed's partner is in it, or was used before
    found = np.mean([min(where[d ^ 1]) <= sequence for sequence, d in seeds if d // 2 % 2])
    print("equal pairs that meet", equal, "seeds with their nearest", found, "of", len(seeds))
    assert equal >= 0.9 and found >= 0.9
