import math
import random

import numpy as np
from pyspark.sql import functions as F

from scoreforge.llm import innerproduct
from scoreforge.llm.innerproduct import NONE, Side, search

SCHEMA = "vec_id long, embedding array<float>, label int, row long, length double, block int"


def whole(v, scale=1024):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * float(np.float32(x))) for x in v]


def brute(rows, step, k):
    clean = [(n, i, whole(v)) for n, (i, v) in enumerate(rows) if whole(v) is not None]
    out = []
    for n, i, q in clean:
        if i is None or i % step:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, c)), j is None, j or 0, j) for m, j, c in clean if m != n)
        out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(scored[:k])]
    return sorted(out, key=str)


def run(spark, rows, step=5, k=10, **sizes):
    df = spark.createDataFrame([(i, v, 1, 2, 0.5, 3) for i, v in rows], SCHEMA)
    got = innerproduct.top_products(df, F.col("vec_id") % step == 0, k=k, **sizes).collect()
    return sorted((tuple(r) for r in got), key=str)


def clustered(n, dims, lengths):
    random.seed(4)
    centres = [[random.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    out = []
    for i in range(n):
        c, size = random.choice(centres), random.choice(lengths)
        out.append((i, [size * (x + random.gauss(0, 0.2)) / math.sqrt(dims) for x in c]))
    return out


def test_matches_brute_force_in_many_cells(spark):
    rows = clustered(300, 12, [0.05, 0.3, 1.0, 4.0])
    want = brute(rows, 5, 10)
    assert run(spark, rows, block=40, query_block=16, head=25) == want
    assert run(spark, rows) == want


def test_ties_copies_and_odd_rows(spark):
    rows = [(i, [0.5, -0.25, 0.125]) for i in range(40)] + [(i % 7, [1.0, 0.0, 0.0]) for i in range(14)]
    rows += [(50, None), (55, [1.0, None, 2.0]), (60, [float("nan"), 0.0, 0.0]), (65, [float("inf"), 0.0, 0.0]), (70, []),
             (75, [1.0]), (80, [0.0, 0.0, 0.0]), (None, [0.5, -0.25, 0.125]), (5, [0.5, -0.25, 0.125])]
    for sizes in ({}, {"block": 9, "query_block": 4, "head": 3}):
        assert run(spark, rows, **sizes) == brute(rows, 5, 10)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (5, [3.0, -1.0]), (7, [0.5, 0.5])]
    assert run(spark, rows) == brute(rows, 5, 10) and len(run(spark, rows)) == 4
    assert run(spark, [(0, [1.0])]) == [] and run(spark, [(3, [1.0]), (4, [2.0])]) == [] and run(spark, []) == []
    assert run(spark, [(0, None)]) == []


def test_products_beyond_double_precision_are_exact_and_saturate(spark):
    rows = [(i, [2.0 ** 20 + i * 0.5, 2.0 ** 19 - i, 1.0]) for i in range(12)] + [(20, [3e38, 1.0, 1.0]), (25, [-3e38, 0.0, 0.0])]
    got = run(spark, rows)
    top = 2 ** 63 - 1
    low = -2 ** 63

    def saturated(v):
        return [min(max(x, low), top) for x in v]
    clean = [(i, saturated(whole(v))) for i, v in rows]
    want = []
    for i, q in clean:
        if i % 5 == 0:
            scored = sorted((-min(max(sum(a * b for a, b in zip(q, c)), low + 1), top), j) for j, c in clean if j != i)
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:10])]
    assert got == sorted(want, key=str)


def test_bounds_leave_little_to_score(monkeypatch):
    """Vectors of different lengths: most are never reached, most of the reached ones fall to the residual bound."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 32))
    x = centres[rng.integers(5, size=4000)] + 0.1 * rng.normal(size=(4000, 32))
    x = np.floor(1024 * x * rng.choice([0.05, 0.2, 1.0], 4000)[:, None]).astype(np.int64)
    x = x[np.argsort(-(x * x).sum(axis=1), kind="stable")]
    _, sizes, turn = np.linalg.svd(x, full_matrices=False)
    cuts = innerproduct.stages(sizes ** 2)
    side, rows, queries = Side(x, turn.T, cuts), np.arange(4000), np.arange(0, 4000, 100)
    asked = Side(x[queries], turn.T, cuts)
    scored = []
    for name in ("products", "pairs"):
        plain = getattr(Side, name)
        monkeypatch.setattr(Side, name, lambda self, i, other, j, f=plain: scored.append(f(self, i, other, j)) or scored[-1])
    found = search(asked, queries, side, rows, rows, np.full(len(queries), NONE), 10, cuts, chunk=256)
    for q, own in enumerate(queries):
        scores = x @ x[own]
        want = [j for j in np.lexsort((rows, -scores)) if j != own][:10]
        assert found.place[found.query == q].tolist() == want
    assert sum(s.size for s in scored) < 0.25 * len(queries) * 4000
