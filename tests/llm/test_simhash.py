import random

import xxhash

from scoreforge.llm import simhash
from scoreforge.llm.components import connected_components

from .conftest import ODD


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def brute_groups(values, budget):
    """Components of values within ``budget`` bits, by comparing all pairs."""
    values, root = list(values), {}
    for v in values:
        root[v] = v

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for i, a in enumerate(values):
        for b in values[:i]:
            if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= budget:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = {}
    for v in values:
        out.setdefault(find(v), set()).add(v)
    return {frozenset(g) for g in out.values() if len(g) > 1}


def test_fingerprint_is_the_majority_of_shingle_bits():
    text = "One  two\tTHREE four\nfive two three"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), seed=42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.simhash(text) == signed(want)
    assert simhash.simhash("Two Words") == signed(xxhash.xxh64_intdigest(b"two words", seed=42))
    assert simhash.simhash(" \n") == 0
    assert simhash.simhash("É É É") != simhash.simhash("é é é")     # only A-Z are folded


def test_links_match_brute_force_even_when_buckets_are_dealt_again(spark):
    random.seed(1)
    fps = {random.getrandbits(64) for _ in range(60)}
    for b in list(fps)[:40]:
        for _ in range(5):
            b ^= (1 << random.randrange(64)) | (1 << random.randrange(64))
            fps.add(b)
    fps |= {(0xABCDEF << 40) | (i * 2654435761 % (1 << 12)) for i in range(120)}
    want = {frozenset(map(signed, g)) for g in brute_groups(fps, 3)}
    table = spark.createDataFrame([(signed(v),) for v in fps], "fp long")
    for bucket_rows in (50_000, 40):
        found = {}
        for r in connected_components(simhash.fingerprint_links(table, 3, bucket_rows)).collect():
            found.setdefault(r["root"], set()).add(r["node"])
        assert {frozenset(g) for g in found.values()} == want


def test_odd_rows(spark, make_docs):
    rows = simhash.simhash_components(make_docs(ODD)).collect()
    assert len(rows) == len(ODD)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["fp"] == by_id[2]["fp"] == by_id[3]["fp"] == 0
    assert [by_id[i]["component_id"] for i in (1, 2, 3)] == [1, 1, 1]
    assert by_id[4]["component_id"] == by_id[5]["component_id"] == 4
    kept = sorted((r["doc_id"] for r in simhash.keep_first(make_docs(ODD)).collect()), key=str)
    assert kept == sorted([1, 4, 4, None, 6, 7], key=str)
    assert simhash.simhash_components(make_docs([])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (500, 500), (None, 3)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 1 for i in range(1, 41)) and all(found[100 + i] == 100 for i in range(30)) and found[500] == 500
