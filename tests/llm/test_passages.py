import itertools
import random

import numpy as np
import pyarrow as pa

from scoreforge.llm import passages as S

from .conftest import ODD


def test_windows_cover_every_subsequence_once_at_its_smallest_key():
    rng = np.random.default_rng(0)
    for n in (3, 4, 20, 50):
        keys = rng.integers(0, 40, n).astype(np.uint64)          # with ties
        seen = {}
        for l, c, r in zip(*S.compact_windows(keys, np.array([0]), np.array([n]), 4)):
            for s in range(l, c + 1):
                for e in range(max(c, s + 3), r + 1):
                    assert (s, e) not in seen
                    seen[s, e] = c
        assert seen == {(s, e): s + int(np.argmin(keys[s:e + 1])) for s in range(n) for e in range(s + 3, n)}


def test_verified_passages_have_the_stated_similarity():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2 ** 60, 300).astype(np.uint64), rng.integers(0, 2 ** 60, 250).astype(np.uint64)
    b[100:200] = a[50:150]
    b[140] = 7
    (s, e, t, u, j), = S.alike(a, b, 46, 0.8)
    assert (s, e, t, u) == (50, 150, 100, 200)
    x, y = set(a[s:e].tolist()), set(b[t:u].tolist())
    assert abs(j - len(x & y) / len(x | y)) < 1e-12
    assert S.alike(a, rng.integers(0, 2 ** 60, 250).astype(np.uint64), 46, 0.8) == []
    b[100:200:4] = 9                                             # too unlike
    assert S.alike(a, b, 46, 0.8) == []


def longest_alike(a, b, span, similarity):
    """Length in a of the longest passage pair, by trying every pair of ends on shared shingles (none repeated)."""
    place = {x: i for i, x in enumerate(b.tolist())}
    both = [(i, place[x]) for i, x in enumerate(a.tolist()) if x in place]
    best = 0
    for n, (s, t) in enumerate(both):
        for m in range(n, len(both)):
            e, u = both[m]
            common = sum(t <= y <= u for _, y in both[n:m + 1])
            p, q = e - s + 1, u - t + 1
            if p >= span and q >= span and common / (p + q - common) >= similarity:
                best = max(best, p)
    return best


def test_insertions_and_deletions_are_found_in_both_orders():
    rng = np.random.default_rng(5)
    fresh = lambda n: rng.integers(0, 2 ** 60, n).astype(np.uint64)
    whole = fresh(76)                                             # 80 words; eight words put in after the 40th
    longer = np.concatenate([whole[:36], fresh(12), whole[40:]])
    for a, b in ((longer, whole), (whole, longer)):
        (*_, j), = S.alike(a, b, 46, 0.8)
        assert abs(j - 72 / 88) < 1e-12
    hits = 0
    for _ in range(150):
        a = np.concatenate([fresh(rng.integers(0, 40)), shared := fresh(rng.integers(50, 90)), fresh(rng.integers(0, 40))])
        for _ in range(rng.integers(0, 4)):                       # cut some out, put others in
            k, n = rng.integers(0, len(shared)), rng.integers(0, 8)
            shared = np.concatenate([shared[:k], fresh(rng.integers(0, 12)), shared[k + n:]])
        b = np.concatenate([fresh(rng.integers(0, 40)), shared, fresh(rng.integers(0, 40))])
        for x, y in ((a, b), (b, a)):
            want, found = longest_alike(x, y, 46, 0.8), S.alike(x, y, 46, 0.8)
            assert bool(found) == bool(want) and (not want or found[0][1] - found[0][0] == want)
            hits += bool(want)
    assert 60 < hits < 300


def planted(seed=3):
    random.seed(seed)
    words = [f"w{i}" for i in range(5000)]
    mk = lambda n: [random.choice(words) for _ in range(n)]
    shared, line, rows, truth = mk(60), mk(12), [], {}
    for d in range(240):
        body = mk(random.randint(10, 300))
        if d % 10 == 0:
            passage = list(shared)
            if d % 20 == 0:
                passage[random.randrange(20, 40)] = "zz"
            at = random.randint(0, len(body))
            body, truth[d] = body[:at] + passage + body[at:], (at, at + 60)
        elif d % 3 == 0:                                          # a common line is too short to be a passage
            at = random.randint(0, len(body))
            body = body[:at] + line + body[at:]
        rows.append((d, " ".join(body)))
    return rows, truth


def test_planted_passages_are_found_and_nothing_else(spark, make_docs):
    rows, truth = planted()
    found = {}
    for r in S.repeated_passages(make_docs(rows)).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert set(found) == set(truth)
    for d, (a, b) in truth.items():
        r, = found[d]
        assert abs(r["start"] - a) <= 5 and abs(r["stop"] - b) <= 5 and r["class_id"] == 0 and r["n_links"] >= 1


def test_frequent_keys_dealt_over_tasks_give_the_same_classes(spark, make_docs, monkeypatch):
    rows, truth = planted(4)
    many = rows + [(1000 + i, rows[0][1] + f" tail{i}") for i in range(1500)]
    found = {r["doc_id"]: r["class_id"] for r in S.repeated_passages(make_docs(many)).collect()}
    assert set(found) == set(truth) | {1000 + i for i in range(1500)} and set(found.values()) == {0}


def variants(seed, n=300, edits=2, length=60):
    """Texts that hold one passage, each with its own edits: most pairs are too unlike, many texts have few partners."""
    random.seed(seed)
    words = [f"w{i}" for i in range(5000)]
    mk = lambda n: [random.choice(words) for _ in range(n)]
    shared, rows = mk(length), []
    for d in range(n):
        passage = list(shared)
        for _ in range(edits):
            passage[random.randrange(length)] = random.choice(words)
        body = mk(random.randint(10, 200))
        at = random.randint(0, len(body))
        rows.append((d, " ".join(body[:at] + passage + body[at:])))
    return rows


def test_texts_of_one_edited_passage_are_found_as_by_all_pairs(spark, make_docs):
    rows = variants(1)
    hashes = [S.shingles(t) for _, t in rows]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if S.alike(hashes[a], hashes[b], 46, 0.8)]
    truth = {x for p in pairs for x in p}
    found = {r["doc_id"]: r["class_id"] for r in S.repeated_passages(make_docs(rows)).collect()}
    assert set(found) <= truth and len(found) >= 0.97 * len(truth) > 100
    assert sum(c == min(truth) for c in found.values()) >= 0.97 * len(truth)      # all pairs give one class


def line_in_pairs(seed, n):
    """2 n texts that share a line of 30 words; texts i and n + i share a passage of 60 words around it, edited beside the line."""
    random.seed(seed)
    words = [f"w{i}" for i in range(20000)]
    mk = lambda n: [random.choice(words) for _ in range(n)]
    line, passages, rows = mk(30), [(mk(15), mk(15)) for _ in range(n)], []
    for d in range(2 * n):
        before, after = map(list, passages[d % n])
        if d >= n:
            (before if d % 2 else after)[random.choice([11, 12, 13]) if d % 2 else random.randrange(1, 4)] = mk(1)[0]
        rows.append((d, " ".join(mk(random.randint(5, 20)) + before + line + after + mk(random.randint(5, 20)))))
    return rows


def test_no_pair_is_lost_among_windows_of_a_frequent_key(spark, make_docs):
    n = 150
    rows = line_in_pairs(3, n)
    hashes = [S.shingles(t) for _, t in rows]
    truth = {(a, b) for a, b in itertools.combinations(range(2 * n), 2) if S.alike(hashes[a], hashes[b], 46, 0.8)}
    assert truth <= {(i, n + i) for i in range(n)} and len(truth) > 100
    for block in (S._BLOCK, 5000):                                # one group a key, and pairs of blocks
        found = {}
        for r in S.repeated_passages(make_docs(rows), block=block).collect():
            found.setdefault(r["class_id"], set()).add(r["doc_id"])
        assert {tuple(sorted(c)) for c in found.values()} == truth


def test_every_pair_of_a_group_is_linked_or_its_windows_marked():
    rng = np.random.default_rng(7)
    n = 600
    of = {"key": np.sort(rng.integers(0, 80, n)), "th": rng.integers(0, 60, n)}
    of["salt"] = np.where(of["key"] % 5 == 0, rng.integers(0, 2, n), -1)
    order = np.lexsort((of["th"], of["salt"], of["key"]))
    of = {f: v[order] for f, v in of.items()} | {f: np.arange(n) for f in ("l", "c", "r")} | {"fn": np.zeros(n, int)}
    table = pa.RecordBatch.from_arrays([pa.array(v) for v in of.values()], list(of))
    for size in (n, 37, 3, 1):
        got = [r for b in S._join_windows()(table.slice(k, size) for k in range(0, n, size)) for r in b.to_pylist()]
        linked = {tuple(sorted((r["ac"], r["bc"]))) for r in got}
        marked = {r[x + "c"] for r in got for bit, x in ((1, "a"), (2, "b")) if r["side"] & bit}
        assert all(r["a"] <= r["b"] and r["a"] == of["th"][r["ac"]] and r["b"] == of["th"][r["bc"]] for r in got)
        for i, j in itertools.combinations(range(n), 2):
            if of["key"][i] == of["key"][j] and of["th"][i] != of["th"][j]:
                assert (i, j) in linked or {i, j} <= marked
        assert marked >= set(np.flatnonzero(of["salt"] >= 0)) and len(got) < 6 * n


def test_windows_tried_in_groups_meet_over_batches_as_in_one():
    rng = np.random.default_rng(11)
    rows = line_in_pairs(5, 12)
    windows = [(i, S.shingles(t)) for i, (_, t) in enumerate(rows)]
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(windows, 2) if S.alike(x, y, 46, 0.8)}
    assert len(want) > 5
    names = ("key", "low", "high", "block", "th", "root", "open", "l", "c", "content")
    held = []
    for key in (1, 2):
        for low, high in ((0, 0), (0, 1), (1, 1)):
            part = [(key, low, high, i % 2, i, i, 1, 0, int(rng.integers(0, 20)), h.tobytes()) for i, h in windows if i % 2 in (low, high)]
            held += part
    table = pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if f == "content" else None) for f, v in zip(names, zip(*held))], list(names))
    for size in (len(held), 7, 1):
        got = [r for b in S._all_pairs(46, 0.8)(table.slice(k, size) for k in range(0, len(held), size)) for r in b.to_pylist()]
        assert sorted((r["a"], r["b"]) for r in got) == sorted([*want] * 2)


def test_windows_of_a_text_with_one_content_are_tried_as_one_and_all_reported():
    h = np.arange(100, 160).astype(np.uint64)
    th, l = np.array([1, 1, 2]), np.array([0, 200, 10])
    found = S.all_alike(th, th, np.ones(3, bool), l, l + 5, [h, h.copy(), h.copy()], np.zeros(3, int), 46, 0.8)
    assert sorted(tuple(map(int, f[:6])) for f in found) == [(1, 2, 0, 60, 10, 70), (1, 2, 200, 260, 10, 70)]


def test_bits_in_common_are_never_fewer_than_the_bound():
    rng = np.random.default_rng(13)
    for _ in range(300):
        shared = rng.integers(0, rng.choice([30, 2 ** 60]), rng.integers(41, 60)).astype(np.uint64)
        a, b = (np.concatenate([shared, rng.integers(0, 2 ** 60, rng.integers(0, 200)).astype(np.uint64)]) for _ in range(2))
        (x, p), (y, q) = S.bit_map(a), S.bit_map(b)
        assert int(np.bitwise_count(x & y).sum()) >= len(shared) - min(p, q)


def test_copies_and_odd_rows(spark, make_docs):
    long = " ".join(f"x{i}" for i in range(80))
    rows = S.repeated_passages(make_docs([*ODD, (20, long), (21, long), (21, long), (22, long + " more")])).collect()
    assert sorted((r["doc_id"], r["class_id"], r["start"]) for r in rows) == [(20, 20, 0), (21, 20, 0), (21, 20, 0), (22, 20, 0)]
    assert {r["stop"] for r in rows} == {80} and {r["n_links"] for r in rows} == {1}
    assert S.repeated_passages(make_docs([])).count() == 0


def test_meeting_matches_counting_orders_at_every_place():
    rng = np.random.default_rng(2)
    n, groups = 300, 40
    group = np.sort(np.concatenate([np.arange(groups), rng.integers(0, groups, n - groups)]))
    fn, lo = rng.integers(0, 4, n).astype(np.int32), rng.integers(0, 60, n)
    hi = lo + rng.integers(0, 25, n)
    for enough in (1, 2, 3, 4):
        found = S.meeting(group, fn, lo, hi, enough, groups)
        for g in range(groups):
            most = max(len({f for k, f, a, b in zip(group, fn, lo, hi) if k == g and a <= x <= b}) for x in range(100))
            assert found[g] == (most >= enough)


def windows_of(th, hashes, key_of):
    """The second look's rows of one text: the windows of its most frequent shingle, two passages' length on either side."""
    l, c, r = S.compact_windows(S.order_keys(hashes, 0), np.array([0]), np.array([len(hashes)]), 46)
    own = hashes[c] == key_of
    l, c, r = np.maximum(l, c - 92)[own], c[own], np.minimum(r, c + 92)[own]
    return [(th, int(a), int(b), hashes[a:d + 1]) for a, b, d in zip(l, c, r)]


def test_overlapping_windows_of_a_text_are_tried_as_one(monkeypatch):
    word = {w: h for w, h in zip("abc", np.array([11, 7, 5], np.uint64))}
    run = lambda text: np.array([word[w] for w in text], np.uint64)
    key = word[min("abc", key=lambda w: int(S.order_keys(run(w), 0)[0]))]
    name = next(w for w, h in word.items() if h == key)
    one, two = [w for w in "abc" if w != name]
    texts = [run(name * 40 + one * 40), run(two * 40 + name * 40), run(name * 90 + two * 20), run(one * 30 + name * 60)]
    tries = []
    real = S.alike
    monkeypatch.setattr(S, "alike", lambda *a, **k: tries.append(1) or real(*a, **k))

    def found(numbers):
        rows = [w for i in numbers for w in windows_of(i, texts[i], key)]
        th, l, c = (np.array(v) for v in list(zip(*rows))[:3])
        return len(rows), S.all_alike(th, th, np.ones(len(rows), bool), l, c, [r[3] for r in rows], np.zeros(len(rows), int), 46, 0.8)
    n, got = found([0, 1])                                        # runs of 40 are no passage
    assert n > 30 and got == [] and len(tries) < 5
    n, got = found([2, 3])                                        # all 90 places lie in passages, 60 in the other text
    assert n > 70 and len(tries) < 40 and {(int(f[0]), int(f[1])) for f in got} == {(2, 3)}
    of_one, of_two = ({k for f in got for k in range(f[i], f[i + 1])} for i in (2, 4))
    assert of_one >= set(range(90)) and of_two >= set(range(30, 90))


def test_contents_hold_a_texts_shingles_once_for_each_key():
    text = " ".join(f"w{i}" for i in range(300))
    rows = [{"key": k, "blocks": 1, "open": 1, "l": l, "c": l + 5, "r": r} for k, l, r in
            ((1, 40, 120), (1, 0, 100), (1, 50, 110), (1, 200, 280), (2, 90, 150), (1, 121, 130))]
    kind = pa.list_(pa.struct([(f, pa.int64() if f == "key" else pa.int32()) for f in rows[0]]))
    batch = pa.RecordBatch.from_arrays([pa.array([9]), pa.array([9]), pa.array([text]), pa.array([rows], kind)], ["th", "root", "text", "rows"])
    got = [r for b in S._contents(60)([batch]) for r in b.to_pylist()]
    assert sum(len(r["content"]) // 8 for r in got) == 131 + 81 + 61 and len(got) == len(rows)
    own = [r for r in got if r["key"] == 1]
    of = lambda f: np.array([r[f] for r in own])
    ranges, _ = S._ranges(of("th"), of("blocks"), of("open") > 0, of("l"), of("c"), [np.frombuffer(r["content"], np.uint64) for r in own])
    assert [(r.low, r.high) for r in ranges] == [(0, 131), (200, 281)]
    assert all((r.content == S.shingles(text)[r.low:r.high]).all() for r in ranges)
    assert sorted(k for r in ranges for k in r.places.tolist()) == [5, 45, 55, 126, 205]


def test_numbered_shingles_in_common_are_never_fewer_than_the_links_of_a_chain():
    rng = np.random.default_rng(17)
    for _ in range(200):
        a, b = (rng.integers(0, rng.choice([2, 10, 60]), rng.integers(46, 120)).astype(np.uint64) for _ in range(2))
        common = len(set.intersection(*(set(h.tolist()) for h in S.numbered([a, b]))))
        assert common == sum(min((a == v).sum(), (b == v).sum()) for v in np.unique(a))
        x, y = S.shared_ids(S.numbered([a, b]), np.array([0, 1], np.int32))
        assert len(x) == len(y) == common and set(x.tolist()) == set(y.tolist())


def test_pairs_that_share_many_shingles_but_no_passage_are_not_tried_one_by_one(monkeypatch):
    rng = np.random.default_rng(19)
    whole, rows = rng.integers(0, 2 ** 60, 180).astype(np.uint64), []
    for d in range(60):
        content = whole.copy()
        for k in range(d % 7, 180, 12):                           # two thirds are left, nowhere four fifths
            content[k:k + 4] = rng.integers(0, 2 ** 60, len(content[k:k + 4]))
        rows.append(content)
    rows[41][20:90] = rows[7][20:90]                              # but for one pair
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if S.alike(rows[a], rows[b], 46, 0.8)}
    tries, real = [], S.alike
    monkeypatch.setattr(S, "alike", lambda *a, **k: tries.append(1) or real(*a, **k))
    th = np.arange(60)
    found = S.all_alike(th, th, np.ones(60, bool), np.zeros(60, int), np.full(60, 90), rows, np.zeros(60, int), 46, 0.8)
    assert (7, 41) in want and {(int(f[0]), int(f[1])) for f in found} <= want and len(found) >= 1
    assert len(tries) < 60 < 60 * 59 // 2


def edited(rng, repeats):
    """Two sequences that share a stretch, with edits on one side; with repeated parts if asked for."""
    fresh = lambda n: rng.integers(0, 2 ** 60, n).astype(np.uint64)
    shared = fresh(int(rng.integers(40, 90)))
    if repeats:
        shared = np.tile(shared[:int(rng.choice([1, 2, 10, 30]))], 90)[:len(shared)]
    other = shared.copy()
    for _ in range(rng.integers(0, 6)):
        k, n = int(rng.integers(0, len(other))), int(rng.integers(0, 5))
        other = np.concatenate([other[:k], fresh(int(rng.integers(0, 5))), other[k + n:]])
    return [np.concatenate([fresh(int(rng.integers(0, 50))), x, fresh(int(rng.integers(0, 50)))]) for x in (shared, other)]


def test_no_pair_with_a_passage_is_left_out_before_it_is_tried():
    rng, seen = np.random.default_rng(23), {True: [0, 0], False: [0, 0]}
    fewest = int(np.ceil(0.8 * 92 / 1.8 - 1e-6))
    for k in range(600):
        a, b = edited(rng, repeats := k % 2 == 0)
        owner = np.array([0, 1], np.int32)
        found = S.alike(a, b, 46, 0.8)
        if repeats:
            found = found + S.alike(a, b, 46, 0.8, counted=True)
            x, y = S.patterns([a, b], owner)
            maybe = not S.unlike(x, y, np.zeros(max(x.max(), y.max(), 0) + 2, bool), 46, 0.8)
        else:
            assert found == S.alike(a, b, 46, 0.8, single=True)
            ids, places = S.shared_places([a, b], owner)
            table = np.full(max((h.max() for h in ids if len(h)), default=0) + 1, -1)
            maybe = bool(S.may_hold(ids, places, 0, np.array([1]), table.astype(np.int64), fewest, 0.8)[0])
        assert maybe or not found
        seen[repeats][0] += bool(found)
        seen[repeats][1] += not maybe
    assert min(*seen[True], *seen[False]) > 20


def test_parts_of_one_pattern_have_the_same_passages():
    rng = np.random.default_rng(29)
    for _ in range(60):
        a, b = edited(rng, True)
        owner = np.array([0, 1], np.int32)
        x, y = S.patterns([a, b], owner)
        renamed = {v: int(n) for v, n in zip(np.unique(np.concatenate([a, b])).tolist(), rng.permutation(10 ** 6))}
        c, d = (np.array([renamed[v] for v in h.tolist()], np.uint64) for h in (a, b))
        assert S.alike(a, b, 46, 0.8) == S.alike(c, d, 46, 0.8)
        s, e = sorted(rng.integers(0, len(a) + 1, 2).tolist())
        part = np.frombuffer(S.pattern_of(x[s:e]), np.int64)
        for i in range(e - s):                                    # a shingle of a alone: its last place, if that lies in the part
            before = [j for j in range(i) if a[s + j] == a[s + i]]
            want = x[s + i] if a[s + i] in b else (before[-1] - i if before else np.iinfo(np.int64).min)
            assert part[i] == want


def test_windows_of_one_text_alone_are_not_marked():
    of = {"key": [1] * 9 + [2] * 9 + [3] * 9, "th": [5] * 9 + [5] * 8 + [6] + [7] * 9, "salt": [-1] * 18 + [4] * 9,
          "l": range(27), "c": range(27), "r": range(27), "fn": [0] * 27}
    rows = pa.RecordBatch.from_arrays([pa.array(list(v)) for v in of.values()], list(of))
    last = pa.RecordBatch.from_arrays([pa.array([9]) for _ in of], list(of))
    got = [r for b in S._join_windows()([pa.concat_batches([rows, last])]) for r in b.to_pylist()]
    marked = {r[x + "c"] for r in got for bit, x in ((1, "a"), (2, "b")) if r["side"] & bit}
    assert marked == set(range(9, 27))
