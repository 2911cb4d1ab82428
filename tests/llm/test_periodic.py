import hashlib
import random
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from scoreforge.llm import periodic
from scoreforge.llm.queries import QUERIES
from scoreforge.sources.tables import read_table

from .conftest import ODD, SF001


def brute_runs(words, least=12):
    """Every maximal stretch of each period, kept if no smaller period holds in it."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            smaller = any(all(words[x] == words[x + d] for x in range(i, j + q - d)) for d in range(1, q))
            if size >= max(least, 2 * q) and not smaller:
                out.append((i, size, q))
            i = j + 1
    return sorted(out)


def brute_row(doc, text, least=12):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, least)
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_match_brute_force():
    random.seed(3)
    for _ in range(1500):
        letters, n = random.choice([1, 2, 3, 5, 40]), random.randrange(0, 60)
        words = [b"%d" % random.randrange(letters) for _ in range(n)]
        if n and random.random() < 0.5:
            a = random.randrange(n)
            p = 1 + (n - a) // random.randrange(2, 6)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        for least in (2, 5, 12):
            assert periodic.runs_of(words, least) == brute_runs(words, least)


def test_extension_is_the_longest_common_prefix():
    random.seed(5)
    s = [random.randrange(2) for _ in range(400)] + [9]
    tree = periodic.SuffixTree(s)
    assert [i for _, i in sorted((s[i:], i) for i in range(len(s)))] == np.argsort(tree.ranks).tolist()
    i, j = np.array([(a, b) for a in range(0, 401, 7) for b in range(401) if a != b]).T
    for a, b, found in zip(i, j, tree.extension(i, j)):
        size = next(k for k in range(401) if s[a + k] != s[b + k])
        assert found == size


def test_words_outside_repeated_stretches_hold_no_run():
    random.seed(7)
    words = [b"%d" % i for i in range(500)]
    words[100:100] = [b"x", b"y", b"z"] * 5
    words += words[20:80]                           # repeated, but far away: no run
    assert periodic.runs_of(words) == [(100, 15, 3)] == brute_runs(words)
    assert periodic.collapsed(words, [(100, 15, 3)]).split() == words[:103] + words[115:]


def test_long_periodic_text_takes_linear_time():
    base = [b"%d" % i for i in range(37)]
    began = time.time()
    assert periodic.runs_of([base[i % 37] for i in range(60_000)]) == [(0, 60_000, 37)]
    assert periodic.runs_of([b"a"] * 60_000) == [(0, 60_000, 1)]
    assert time.time() - began < 30


def test_odd_rows(spark, make_docs):
    docs = make_docs(ODD + [(9, "A b c " * 20)]).withColumn("periodic", F.lit(1)).drop("periodic")
    rows = periodic.run_report(periodic.periodic_runs(
        docs.withColumn("text", periodic.repeated_tails(F.col("text"), F.col("doc_id"))))).collect()
    want = sorted((brute_row(i, t) for i, t in ODD + [(9, "A b c " * 20)] if i not in (None, 6)), key=str)
    assert sorted((tuple(r) for r in rows if r["doc_id"] not in (None, 6)), key=str) == want
    long = next(r for r in rows if r["doc_id"] == 6)
    assert (long["n_runs"], long["start"], long["length"], long["period"], long["exponent_milli"]) == (1, 0, 20_000, 1, 20_000_000)
    assert len(rows) == len(ODD) + 1
    assert periodic.periodic_runs(make_docs([])).count() == 0


def test_query_matches_brute_force(spark):
    docs = read_table(spark, SF001, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF001).collect()}
    assert len(got) == len(docs)
    small = [r for r in docs if len(r["text"] or "") < 6000]
    assert len(small) > 100 and any(got[r["doc_id"]][1] for r in small)
    for r in small:
        assert got[r["doc_id"]] == brute_row(r["doc_id"], r["text"])
