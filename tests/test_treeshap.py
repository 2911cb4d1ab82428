import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from scoreforge.operators import model as MD
from scoreforge.operators import treeshap as TS


def _random_tree(rng, depth, n_features):
    nodes = {}

    def build(nid, d, count):
        if d == 0 or count < 2:
            nodes[nid] = TS.Node(nid, float(rng.normal()), count, -1, -1, -1, float("nan"))
            return
        f = int(rng.integers(0, n_features))
        lc = float(rng.integers(1, int(count)))
        nodes[nid] = TS.Node(nid, 0.0, count, 2 * nid + 1, 2 * nid + 2, f, float(rng.normal()))
        build(2 * nid + 1, d - 1, lc)
        build(2 * nid + 2, d - 1, count - lc)

    build(0, depth, 200.0)
    return nodes


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_tree_shap_equals_exhaustive_shapley(seed):
    rng = np.random.default_rng(seed)
    nodes = _random_tree(rng, 4, 4)
    tables, base = TS.leaf_paths(nodes, 0, 0.7)
    x = rng.normal(size=(10, 4))
    phi = TS.contributions(x, tables, 4)
    for r in range(10):
        assert np.allclose(phi[r], 0.7 * TS.brute_force(x[r], nodes, 0, 4), atol=1e-12)


def test_additivity_on_spark_gbt(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double") \
        .withColumn("y", F.col("a") * 0.3 - F.col("b") * F.col("c") * 0.2)
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    fm = MD.gbt_fit(df, "features", "y", {"maxIter": 8, "maxDepth": 3, "maxBins": 32})
    path = str(tmp_path / "m")
    MD.save_model(fm, spark, path)
    contrib = MD.tree_contributions(df, spark, path, ["a", "b", "c"], "id")
    raw = fm.predict(df, clip=False).select("id", F.col("prediction").alias("p"))
    s = F.aggregate("contrib", F.lit(0.0), lambda acc, c: acc + c["shap"])
    worst = contrib.join(raw, "id").agg(F.max(F.abs(F.col("expected_value") + s - F.col("p")))).first()[0]
    assert worst < 1e-6


def test_permutation_importance_and_sampled_shap(spark, tmp_path):
    from scoreforge.operators.sampling_shap import sampled_contributions

    rng = np.random.default_rng(9)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").withColumn("y", F.col("a") * 0.5)
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    fm = MD.gbt_fit(df, "features", "y", {"maxIter": 10, "maxDepth": 3, "maxBins": 32})
    imp = {r["feature"]: r["importance"] for r in MD.feature_importance(
        fm, spark, ["a", "b", "c"], "permutation", df, "id", "y").collect()}
    assert imp["a"] > 0.1 and abs(imp["b"]) < 0.05 and abs(imp["c"]) < 0.05

    assert imp["b"] == 0.0 or "b" in {["a", "b", "c"][f] for f in MD.ensemble_of(fm, spark).trees_of}
    # a linear scorer: w_j (x_j - mean of the background); contributions add up to f(x) - expected value
    w = np.array([0.3, -0.2, 0.1])
    c = sampled_contributions(df, "id", "features", lambda x: 0.5 + x @ w, ["a", "b", "c"], background=20)
    got = {}
    for r in c.collect():
        got.setdefault(r["id"], {})[r["feature"]] = r
    assert len(got) == 400 and all(len(v) == 3 for v in got.values())
    for i, *x in rows:
        total = sum(r["shap"] for r in got[i].values())
        assert abs(total - (0.5 + float(np.dot(w, x)) - got[i]["a"]["expected_value"])) < 1e-9
        assert [got[i][f]["value"] for f in "abc"] == x
    # a fitted ensemble as the scorer: the same raw predictions
    raw = {r["id"]: r["prediction"] for r in fm.predict(df, clip=False).collect()}
    mine = MD.ensemble_of(fm, spark).predict(np.array([x for _, *x in rows]))
    assert np.allclose(mine, [raw[i] for i, *_ in rows], atol=1e-9)


def _shapley(x, background, score):
    """Exhaustive Shapley values of the mean score over the background."""
    d = len(x)

    def value(s):
        rows = background.copy()
        rows[:, list(s)] = x[list(s)]
        return score(rows).mean()
    phi = np.zeros(d)
    for i in range(d):
        for r in range(d):
            for s in itertools.combinations([j for j in range(d) if j != i], r):
                weight = math.factorial(r) * math.factorial(d - r - 1) / math.factorial(d)
                phi[i] += weight * (value(s + (i,)) - value(s))
    return phi


def test_kernel_fit_is_the_shapley_value_of_a_tree_scorer():
    from scoreforge.operators import sampling_shap as K
    from scoreforge.operators.ensemble import Ensemble
    rng = np.random.default_rng(4)
    for d, evaluations in ((1, 100), (2, 100), (5, 100), (6, 100)):
        score = Ensemble({t: _random_tree(rng, 4, d) for t in range(3)}, [1.0, 0.5, 0.25]).predict
        x, background = rng.normal(size=(4, d)), rng.normal(size=(7, d))
        z, w = K.coalitions(d, evaluations)
        assert len(z) == 2 ** d - 2
        phi = K.kernel_contributions(x, background, z, K.solver(z, w), score)
        assert np.allclose(phi, [_shapley(r, background, score) for r in x], atol=1e-9)
    # more coalitions than evaluations: bounded work, the sum still exact, values near
    score = Ensemble({t: _random_tree(rng, 3, 9) for t in range(3)}, [1.0, 0.5, 0.25]).predict
    x, background = rng.normal(size=(3, 9)), rng.normal(size=(6, 9))
    z, w = K.coalitions(9, 100)
    assert len(z) <= 100
    phi = K.kernel_contributions(x, background, z, K.solver(z, w), score)
    assert np.allclose(phi.sum(axis=1), score(x) - score(background).mean(), atol=1e-9)
    assert np.abs(phi - [_shapley(r, background, score) for r in x]).max() < 0.3 * np.ptp(score(background)) + 0.05


def test_depth_eight_paths_are_exact_and_small(spark):
    rng = np.random.default_rng(8)
    nodes = _random_tree(rng, 8, 9)
    paths, base = TS.leaf_paths(nodes, 0, 1.0)
    x = rng.normal(size=(3, 9))
    phi = TS.contributions(x, paths, 9)
    assert np.allclose(phi[0], TS.brute_force(x[0], nodes, 0, 9), atol=1e-10)
    assert sum(len(p.features) for p in paths) <= 8 * len(nodes)


def test_kept_trees_predict_like_a_shorter_fit(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, *map(float, rng.normal(size=2))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double").withColumn("y", F.col("a") * 0.3 + F.col("b"))
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    params = {"maxIter": 6, "maxDepth": 3, "maxBins": 32}
    long, short = MD.gbt_fit(df, "features", "y", params), MD.gbt_fit(df, "features", "y", {**params, "maxIter": 4})
    cut = MD.first_trees(long.model, 4)
    assert cut.getNumTrees == 4
    long.model = cut
    MD.save_model(long, spark, str(tmp_path / "m"))
    again = MD.load_model(spark, str(tmp_path / "m"))
    for fm in (long, again):
        got = {r["id"]: r["prediction"] for r in fm.predict(df, clip=False).collect()}
        assert all(abs(got[r["id"]] - r["prediction"]) < 1e-12 for r in short.predict(df, clip=False).collect())
