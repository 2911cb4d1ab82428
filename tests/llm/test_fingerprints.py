import hashlib
import random

import numpy as np

from scoreforge.llm import fingerprints as P

from .conftest import ODD, SF001


def test_span_equality_and_extensions():
    random.seed(0)
    a = "".join(random.choice("ab") for _ in range(400))
    b = "".join(random.choice("ab") for _ in range(50)) + a[100:300] + "\U0001F600é" + a[:40]
    x, y = P.PrefixHash(P.points_of(a)), P.PrefixHash(P.points_of(b))
    for _ in range(300):
        i, j = random.randrange(len(a)), random.randrange(len(b))
        n = random.randint(0, min(len(a) - i, len(b) - j, 12))
        assert (x.span(i, i + n) == y.span(j, j + n)) == (a[i:i + n] == b[j:j + n])
        want = 0
        while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
            want += 1
        assert x.extension(i, y, j) == want
    assert x.extension(100, y, 50) >= 200
    assert P.PrefixHash(P.points_of("")).span(0, 0) == 0


def test_shared_head_gives_the_same_arrays():
    a, b = P.points_of("the same head, then one end"), P.points_of("the same head, another")
    whole, reused = P.PrefixHash(b), P.PrefixHash(b, P.PrefixHash(a), 15)
    assert all((u == v).all() for u, v in zip(whole.sums, reused.sums))


def spans(text, width=16):
    return {text[i:i + width] for i in range(max(1, len(text) - width + 1))}


def check(rows, docs):
    docs = sorted(docs, key=lambda d: d[0])
    rows = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs)
    prints = {}
    for k, (i, text) in enumerate(docs):
        text, following = text or "", docs[(k + 1) % len(docs)][1] or ""
        q = len(text) // 4
        edited = text[:len(text) - q] + following[:q]
        r = rows[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for own, p in ((text, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert prints.setdefault(own, p) == p
        a, e, n = spans(text), spans(edited), spans(following)
        assert abs(r["near_edited"] - len(a & e) / len(a | e)) < 0.3
        assert abs(r["near_next"] - len(a & n) / len(a | n)) < 0.3
    assert len(set(prints.values())) == len(prints)


def test_table_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    check(P.edited_fingerprints(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_next_document_across_ranges_and_odd_rows(spark, make_docs):
    docs = [(i * 7, f"document {i} " * (i % 5)) for i in range(200)] + [(9001, None), (9002, ""), (9003, "long " * 30_000)]
    check(P.edited_fingerprints(make_docs(docs)).collect(), docs)
    rows = P.edited_fingerprints(make_docs(ODD)).collect()
    assert len(rows) == len(ODD)
    first = next(r for r in rows if r["doc_id"] is None)      # nulls come first, so its next is document 1
    assert first["edited_sha256"] == hashlib.sha256(b"no id he").hexdigest()
    assert P.edited_fingerprints(make_docs([])).count() == 0
    one, = P.edited_fingerprints(make_docs([(3, "only this text")])).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"only this tonl").hexdigest() and one["near_next"] == 1.0


def test_likeness_bounds():
    text = lambda s: P.Text(s, 16, 64).print
    assert P.likeness(text(""), text(""), 64) == 1.0
    assert P.likeness(text(""), text("some text"), 64) == 0.0
    assert P.likeness(text("abc" * 99), text("abc" * 99), 64) == 1.0
    assert np.array_equal(P._mod(np.array([P.P, 2 * P.P + 5, (1 << 62) - 1], np.uint64)),
                          [0, 5, ((1 << 62) - 1) % P.P])
