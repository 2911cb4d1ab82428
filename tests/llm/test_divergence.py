import random
import re
from collections import Counter

from pyspark.sql import functions as F

from scoreforge.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, block int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(rows, least, top):
    rows = [(t or "", lang or "", source or "") for _, t, lang, source in rows]
    counts, docs = {}, {}
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(LOWER))
        counts.setdefault(lang, {}).setdefault(source, Counter()).update(terms)
        docs.setdefault(lang, Counter()).update(set(terms))
    out = []
    for lang, groups in counts.items():
        kept = sorted(t for t, d in docs[lang].items() if d >= least)
        whole = sum(groups.values(), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        for s in groups:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(items)]
    return sorted(out)


def fixture(n=400):
    random.seed(11)
    words = ["alpha", "Beta", "ÉTÉ", "été", "naïve", "gamma", "the", "THE", "x", "日本", "ﬁ", "rare%d"]
    rows = []
    for i in range(n):
        lang, source = random.choice(["en", "fr", None, ""]), random.choice(["s%d" % k for k in range(9)] + [None, "hot"] * 3)
        weights = [1 + (hash_of(source) * (k + 3)) % 7 for k in range(len(words))]
        text = "".join(w.replace("%d", str(i)) + random.choice([" ", "-", "1", "_", " ", "\n"])
                       for w in random.choices(words, weights, k=random.randrange(0, 30)))
        rows.append((i, random.choice([text] * 9 + [None]), lang, source))
    return rows + rows[:5] + [(900, "alone", "de", "only"), (901, None, "it", "a"), (902, "", "it", "b"), (None, "the x", "en", "s1")]


def hash_of(source):
    return sum((source or "").encode())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, "clash", 1) for i, t, lang, s in rows], DOCS)


def test_matches_brute_force_at_any_block_size(spark):
    rows = fixture()
    for group_block, term_block, top in ((2, 3, 4), (100, 100_000, 50)):
        got = divergence.audit_sources(frame(spark, rows), 10, top, group_block, term_block).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, 10, top)


def test_groups_without_kept_terms(spark):
    rows = [(1, "one", "it", "a"), (2, "two", "it", "b"), (3, None, "it", None), (4, "x", "de", "alone")]
    got = divergence.audit_sources(frame(spark, rows), 30).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 30, 50)
    assert len(got) == 6 and {r["value"] for r in got} == {0}
    assert divergence.audit_sources(frame(spark, [])).count() == 0


def test_counts_handed_on_in_parts_add_up(spark, monkeypatch):
    rows = fixture(60)
    held = divergence._Held()
    for _, t, lang, s in rows:
        held.add(((lang or "").encode(), (s or "").encode()), divergence.terms_of((t or "").encode()))
    whole = Counter()
    for r in held.batch().to_pylist():
        whole[r["lang"], r["source"], r["term"]] += r["n"]
    assert not held.n and held.size == 0
    got = {(r["lang"], r["source"], r["term"]): r["n"] for r in divergence.term_counts(frame(spark, rows)).collect()}
    assert got == dict(whole)


def test_shares_are_exact_where_products_overflow(spark):
    random.seed(2)
    cases = [(0, 0, 1), (7, 7, 1), (8 * 10 ** 15, 8 * 10 ** 15, 1)]
    for _ in range(300):
        total = random.randrange(10 ** random.randrange(1, 16))
        cases.append((random.randrange(total + 1), total, random.randrange(1, 10 ** random.randrange(1, 9))))
    df = spark.createDataFrame(cases, "c long, t long, v long")
    for r in df.select("*", divergence.share("c", "t", "v").alias("p")).collect():
        assert r["p"] == 1 + 10 ** 9 * (r["c"] + 5) // (r["t"] + 5 * r["v"])


def test_each_count_goes_to_every_block_of_its_language(spark):
    """Cells of the cube: with 9 groups and blocks of 2, five blocks meet in 15 pairs."""
    rows = [(i, f"{'abcde'[i % 5]} {'ab'[i % 2]}", "en", f"s{i % 9}") for i in range(90)]
    shares = divergence.Shares(frame(spark, rows), 2, 2, 2)
    assert shares.groups.select("block").distinct().count() == 5
    assert {r["slices"] for r in shares.groups.collect()} == {3}
    pairs = divergence.pair_divergences(shares)
    assert pairs.count() == 72 and pairs.groupBy("lang", "source", "item").count().where(F.col("count") > 1).count() == 0
