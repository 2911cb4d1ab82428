import numpy as np
import pytest

from scoreforge.functions.quantiles import exact_quantiles, grouped_quantiles, long_form


@pytest.mark.parametrize("kw", [{}, {"sort_limit": 50, "buckets": 8}, {"sort_limit": 3, "buckets": 2}])
def test_exact_quantiles_match_numpy(spark, kw):
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.normal(size=400), np.full(100, 2.5), rng.integers(0, 5, 100)])
    b = rng.exponential(size=600)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs, **kw)
    for c, arr in (("a", a), ("b", b)):
        for p in probs:
            assert got[(c, p)] == pytest.approx(float(np.quantile(arr, p)), rel=1e-12, abs=1e-12)


def test_quantiles_skip_null_nan_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), None), (3.0, None)], "a double, b double")
    got = exact_quantiles(df, ["a", "b"], [0.5])
    assert got[("a", 0.5)] == 2.0 and got[("b", 0.5)] is None


def test_single_row(spark):
    df = spark.createDataFrame([(7.0,)], "a double")
    assert exact_quantiles(df, ["a"], [0.25, 0.75]) == {("a", 0.25): 7.0, ("a", 0.75): 7.0}


def test_grouped(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "a double")
    got = grouped_quantiles(long_form(df, ["a"]), [0.5], sort_limit=4, buckets=2)
    assert got[("a", 0.5)] == 5.0


@pytest.mark.parametrize("kw", [{}, {"sort_limit": 3, "buckets": 2}])
def test_infinities_and_wide_ranges(spark, kw):
    inf = float("inf")
    values = [-inf, *(10.0 ** e for e in range(-300, 300, 5)), *([1.5] * 200), inf, inf, inf]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    probs = [0.0, 0.003, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["a"], probs, **kw)
    ranked = sorted(values)
    for p in probs:
        at = p * (len(ranked) - 1)
        x, y = ranked[int(at)], ranked[min(int(at) + 1, len(ranked) - 1)]
        assert got[("a", p)] == (x if x == y else pytest.approx(x + (y - x) * (at - int(at)), nan_ok=True))


def test_columns_are_read_side_by_side(spark):
    """Quantiles of several columns come from whole-table aggregates: no row per column, no join."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(500, 3)).round(2)], "a double, b double, c double")
    from scoreforge.functions import quantiles as Q
    asked, before = [], Q.long_form
    Q.long_form = lambda *a: asked.append(a) or before(*a)
    try:
        got = exact_quantiles(df, ["a", "b", "c"], [0.25, 0.75])
    finally:
        Q.long_form = before
    assert not asked
    data = np.array([list(r) for r in df.collect()])
    for i, c in enumerate("abc"):
        for p in (0.25, 0.75):
            assert got[(c, p)] == pytest.approx(float(np.quantile(data[:, i], p)), rel=1e-12)


def test_ranks_outside_the_sketched_gaps_go_on(spark):
    values = [float(i * i % 7919) for i in range(3000)]
    df = spark.createDataFrame([(v, -v) for v in values], "a double, b double").repartition(5)
    for kw in ({"sort_limit": 40, "buckets": 16}, {"sort_limit": 5, "buckets": 200}):
        got = exact_quantiles(df, ["a", "b"], [0.1, 0.5, 0.51, 0.99], **kw)
        for p in (0.1, 0.5, 0.51, 0.99):
            assert got[("a", p)] == pytest.approx(float(np.quantile(values, p)), rel=1e-12)
            assert got[("b", p)] == pytest.approx(float(np.quantile([-v for v in values], p)), rel=1e-12)
